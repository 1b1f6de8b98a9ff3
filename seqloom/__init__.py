"""Click sequences on Spark: sessions, item sequences, latent-state models, ranking, evaluation.

>>> spark = seqloom.prepare(spark)
>>> sess = settle(sessionize(clicks))                        # (user_id, chunk, session_ix, item_id, n)
>>> dim = dictionary(sess)                                    # (item_id, item_ix)
>>> seqs = sequences(item_positions(encode(sess, dim)))
>>> models = fit(seqs, [random_model(dim, 50, Prior(), seed=1)], Prior(), max_iter=90)
>>> recommend(request_states(requests, dim, models[0]), models[0], n=10)
"""

from .operators.binning import bin_numeric, encode_category
from .operators.em import Prior, fit, log_prior, random_model, reestimate
from .operators.estep import log_likelihood, next_state, posterior, sequences
from .operators.model import Model, load, save
from .operators.scoring import recommend, request_rows, request_states, score_targets
from .operators.sessions import (
    dictionary,
    encode,
    item_positions,
    reencode,
    session_positions,
    sessionize,
)
from .runtime import prepare, settle
from .streaming.online import online_sessions, online_states

__all__ = [
    "Model",
    "Prior",
    "bin_numeric",
    "dictionary",
    "encode",
    "encode_category",
    "fit",
    "item_positions",
    "load",
    "log_likelihood",
    "log_prior",
    "next_state",
    "online_sessions",
    "online_states",
    "posterior",
    "prepare",
    "random_model",
    "recommend",
    "reencode",
    "reestimate",
    "request_rows",
    "request_states",
    "save",
    "score_targets",
    "sequences",
    "session_positions",
    "sessionize",
    "settle",
]
