from .scalars import (  # noqa: F401
    digitize,
    label,
    neg_xlogx,
    pair_lists,
    pseudo_user,
    top_positions,
)
