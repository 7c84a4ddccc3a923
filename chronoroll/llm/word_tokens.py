"""Token ids of a lower-casing byte-level BPE with word ends, in Arrow batches.

The ids are those of the tokenizers library. Texts of Latin letters, figures and signs
are cut into words by an equal pattern, and every distinct word is encoded once, by
blocks of agendas (``bpe.PairTable``). Other texts are cut at white space, which no
token holds, and every distinct cut that has other characters goes to the library. A text that
holds the string of an added token (such as an end mark) goes to the library as a whole, which
takes that string for the token, as it does by default.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata

import numpy as np

from .bpe import PairTable, Recent

#: Texts for which lower case and the pattern are the same in any Unicode version.
PLAIN = re.compile("[ \t-\r!-~¡-ÿĀ-įĲ-ſ]*")
_LATIN = [chr(c) for c in range(0x180)]
_L, _N = ("".join(c for c in _LATIN if unicodedata.category(c)[0] == k) for k in "LN")
#: The vocabulary's pattern, for such texts.
PLAIN_WORDS = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^ \t-\r{_L}{_N}]+")
CACHE = 300_000


class WordCodec:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, added = whole["model"], [t["content"] for t in whole.get("added_tokens") or []]
        #: Texts that hold an added token's string, in any case: more than the library matches, never less.
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE).search
        self.lead = re.match("[ -@[-`{-~]*", os.path.commonprefix(added))[0]  # in no case other than its own, and fast to look for
        vocab = model["vocab"]
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.table = PairTable(pairs)
        # Bytes that are printable characters stand for themselves, the others for those from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[char[b] + "</w>"] for b in range(256)], np.int32)
        self.find = PLAIN_WORDS.findall
        self.known, self.words = Recent(CACHE), Recent(CACHE)

    def learn(self, cuts: set[bytes]) -> None:
        new = self.known.missing(cuts)
        texts = [c.decode() for c in new]
        plain = [PLAIN.fullmatch(t) is not None for t in texts]
        parts = [self.find(t.lower()) if p else () for t, p in zip(texts, plain)]
        self.learn_words(set().union(*parts))
        get = self.words.young.__getitem__
        rest = iter(self.library.encode_batch([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        young = self.known.young
        for c, p, words in zip(new, plain, parts):
            young[c] = b"".join(map(get, words)) if p else np.array(next(rest).ids, "<u4").tobytes()

    def learn_words(self, words: set[str]) -> None:
        new = self.words.missing(words)
        raw = [w.encode() for w in new]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        codes = np.frombuffer(b"".join(raw), np.uint8)
        flat = self.inner[codes]
        ends = np.cumsum(sizes)
        if len(flat):
            flat[ends - 1] = self.last[codes[ends - 1]]
        ids, sizes = self.table.merge_all(flat, sizes)
        ends = (np.cumsum(sizes) * 4).tolist()
        out = ids.astype("<u4").tobytes()
        self.words.young.update(zip(new, (out[a:b] for a, b in zip([0, *ends], ends))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        special = [k for k, t in enumerate(texts) if t and self.lead in t and self.special(t)]
        whole = dict(zip(special, self.library.encode_batch([texts[k] for k in special], add_special_tokens=False)))
        texts = [None if k in whole else t for k, t in enumerate(texts)]
        plain = [t is None or PLAIN.fullmatch(t) is not None for t in texts]
        cuts = [(self.find(t.lower()) if p else t.encode().split()) if t else [] for t, p in zip(texts, plain)]  # bytes split at ASCII white space only
        self.learn(set().union(*(c for c, p in zip(cuts, plain) if not p)))
        self.learn_words(set().union(*(c for c, p in zip(cuts, plain) if p)))
        get = (self.known.young.__getitem__, self.words.young.__getitem__)
        return [np.array(whole[k].ids, "<u4").tobytes() if k in whole else b"".join(map(get[p], c)) for k, (c, p) in enumerate(zip(cuts, plain))]


@functools.lru_cache(2)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
