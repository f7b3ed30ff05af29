"""Token ids of a public byte-level BPE vocabulary.

The ids are those of ``tokenizers`` for the JSON file.  For texts made of
characters on which both libraries split words alike (ASCII without control
characters, Latin letters, common punctuation) they are taken from the same
vocabulary's rank file through ``tiktoken``, which is five times as fast; any
other text goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

_OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u017f\\u2010-\\u201f\\u2026\\u20ac]")
#: one unbroken run of this many characters goes to ``tokenizers``
_LONG_RUN = re.compile(r"\S{2000}|\s{2000}")


def vocabulary_path(name: str) -> str:
    """``name`` if it is a path on this machine, else the installed file of that name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, name: str):
        from tokenizers import Tokenizer

        path = vocabulary_path(name)
        self.exact = Tokenizer.from_file(path)
        self.fast = None
        ranks_path = re.sub(r"\.json$", ".tiktoken", path)
        if ranks_path != path and os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.fast is not None and not _OTHER.search(text) and not _LONG_RUN.search(text):
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(name)
