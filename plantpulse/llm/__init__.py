"""Training-data operators. Each module holds one operator with its registered
query; importing this package loads them all."""

from . import (  # noqa: F401
    bpe, chat, embeddings, fingerprint, idfile, lines, neardup, ngram, packing, phrases, pii, quality, variants,
)
from .common import ORACLES, QUERIES  # noqa: F401
