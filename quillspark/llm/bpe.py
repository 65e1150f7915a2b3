"""BPE encoding and decoding by tree concatenation.

Where a tokenizer's own splitting never crosses white space, a text is split there, and each distinct run is encoded once
per batch of work. A long unsplit piece is halved down to leaves, the leaves are encoded as one parallel
batch, and neighbours are concatenated up the tree: a window around each join is encoded anew and grown until both
sides agree with it on whole tokens, which makes the spliced sequence the encoding of the whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Longest piece that is encoded as it is, first reach of a window, and consecutive tokens that have to agree.
LEAF, REACH, AGREE = 24, 64, 3
#: Distinct runs remembered by a worker; then it starts anew. Only speed depends on it.
REMEMBERED = 400_000

_STOPS = re.compile(rb"(?<=[a-z])([.,])(?=[ \n\t\r\x0b\x0c]|\Z)")
Token = tuple[int, int]  # start in the piece, id


class TreeBpe:
    """Encoder and decoder for a BPE tokenizer file of the tokenizers library.

    Texts are split at white space only where the file's own splitting never crosses it and drops it; with any other
    file the whole text is one run.
    """

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.bare = Tokenizer(self.full.model)
        self.leaf = leaf
        special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.special = {s: self.full.token_to_id(s) for s in special}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.known: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.decimal = [b"%d" % i for i in range(self.full.get_vocab_size())]
        self.token = [(self.full.id_to_token(i) or "").encode() for i in range(self.full.get_vocab_size())]
        #: Where the file lower-cases, texts may be lower-cased before, but for the names of special tokens.
        self.lowers = self.full.normalizer is not None and self.full.normalizer.normalize_str("Aa") == "aa"
        self.opens = [s.encode()[:2] for s in special]

        # one, two and other kinds of white space between and around words, digits, stops and apostrophes; a file that treats
        # some other run otherwise than apart from its neighbours is not told by it
        probe = "a b  ab 1\tx.y\n z \r\n. b\x0b'\x0cs a"
        apart = [i for x in probe.split() for i in self.full.encode(x, add_special_tokens=False).ids]
        self.by_space = self.full.encode(probe, add_special_tokens=False).ids == apart and self.full.decoder is None

    # --- one unsplit piece
    def _leaves(self, pieces: list[tuple[int, str]]) -> list[list[Token]]:
        found = self.bare.encode_batch([s for _, s in pieces], add_special_tokens=False)
        return [[(at + a, i) for (a, _), i in zip(e.offsets, e.ids)] for (at, _), e in zip(pieces, found)]

    def piece(self, s: str) -> list[int]:
        """Ids of a piece that the pre-tokenizer leaves whole."""
        if len(s) <= self.leaf:
            return self.bare.encode(s, add_special_tokens=False).ids
        cuts = [0, len(s)]
        while max(b - a for a, b in zip(cuts, cuts[1:])) > self.leaf:
            cuts = [c for a, b in zip(cuts, cuts[1:]) for c in (a, (a + b) // 2)] + [len(s)]
        parts = self._leaves([(a, s[a:b]) for a, b in zip(cuts, cuts[1:])])
        while len(parts) > 1:
            cuts, joined = cuts[::2], []
            for k, at in enumerate(cuts[:-1]):
                joined.append(self._join(s, at, parts[2 * k], parts[2 * k + 1], cuts[k + 1]))
            parts = joined
        return [i for _, i in parts[0]]

    def _join(self, s: str, start: int, left: list[Token], right: list[Token], end: int) -> list[Token]:
        cut, reach = right[0][0], REACH
        while True:
            lo, hi = max(start, cut - reach), min(end, cut + reach)
            window = self._leaves([(lo, s[lo:hi])])[0]
            a = (0, 0) if lo == start else self._shared(left, window, lo, cut)
            b = (len(right), len(window)) if hi == end else self._shared(right, window, cut, hi, last=True)
            if a and b and a[1] <= b[1]:
                return left[: a[0]] + window[a[1] : b[1]] + right[b[0] :]
            reach *= 2

    @staticmethod
    def _shared(side: list[Token], window: list[Token], lo: int, hi: int, last: bool = False) -> tuple[int, int] | None:
        """Where AGREE consecutive tokens of both are the same, in [lo, hi): nearest to the window's outer end."""
        at = {t: k for k, t in enumerate(window)}
        i, j = bisect_left(side, (lo, -1)), bisect_left(side, (hi, -1))
        places = range(j - AGREE, i - 1, -1) if last else range(i, j - AGREE + 1)
        for k in places:
            w = at.get(side[k])
            if w is not None and side[k : k + AGREE] == window[w : w + AGREE]:
                return k, w
        return None

    # --- texts
    def run(self, run: str) -> list[int]:
        """Ids of a run without white space."""
        if len(run) <= self.leaf:
            return self.full.encode(run, add_special_tokens=False).ids
        out: list[int] = []
        for part in self.at_special.split(run) if self.at_special else [run]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = self.full.normalizer.normalize_str(part) if self.full.normalizer else part
                words = self.full.pre_tokenizer.pre_tokenize_str(part) if self.full.pre_tokenizer else [(part, None)]
                for word, _ in words:
                    out += self.piece(word)
        return out

    def learn(self, new: list[bytes]) -> None:
        """Encode runs; the short ones as one text, whose tokens are dealt out by their offsets."""
        short, own = [p for p in new if len(p) <= self.leaf], {}
        if short:
            found = [p.decode() for p in short]
            e = self.full.encode(" ".join(found), add_special_tokens=False)
            starts = np.cumsum([0] + [len(x) + 1 for x in found])
            cuts = np.searchsorted(np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0], starts).tolist()
            ids = e.ids
            own = {p: ids[a:b] for p, a, b in zip(short, cuts, cuts[1:])}
        for p in new:
            x = own[p] if p in own else self.run(p.decode())
            self.known[p] = (len(x), b" ".join([self.decimal[i] for i in x]), b" ".join([self.token[i] for i in x]))

    def runs(self, text: str) -> list[tuple[int, bytes, bytes]]:
        """(tokens, decimal ids, decoded text) of every run that has tokens.

        A full stop or comma after an ASCII letter is a run of its own where white space follows: the splitting pattern
        separates it too, so fewer distinct runs are encoded.
        """
        data = text.encode("utf-8", "replace")
        if not self.by_space:
            ids = self.run(data.decode())
            return [(len(ids), b" ".join([self.decimal[i] for i in ids]), self.full.decode(ids, skip_special_tokens=False).encode())] if ids else []
        if self.lowers and not any(x in data for x in self.opens):
            data = _STOPS.sub(rb" \1", data.lower())
        parts = data.split()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        self.learn([p for p in set(parts) if p not in known])
        return [k for p in parts if (k := known[p])[0]]

    def encode(self, text: str | None) -> list[int]:
        """The library's ids of the whole text; none for a null or empty one."""
        return [int(i) for _, x, _ in self.runs(text or "") for i in x.split()]

    def decode(self, ids: list[int]) -> str:
        """The library's text of the ids, decoded in halves."""
        if len(ids) <= 1 << 16 or not self.by_space:
            return self.full.decode(ids, skip_special_tokens=False)
        half = len(ids) // 2
        return f"{self.decode(ids[:half])} {self.decode(ids[half:])}"

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the decimal ids and of the decoded text."""
        runs = self.runs(text or "")
        sha = lambda k: hashlib.sha256(b" ".join([r[k] for r in runs])).hexdigest()
        return sum(r[0] for r in runs), sha(1), sha(2)


_loaded: dict[str, TreeBpe] = {}


def loaded(path: str) -> TreeBpe:
    if path not in _loaded:
        _loaded[path] = TreeBpe(path)
    return _loaded[path]


def encode_column(df: DataFrame, path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """``df`` with an array of ids; null and empty texts get an empty array. A column named ``out_col`` is replaced."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(s):  # noqa: ANN001, ANN202
        return s.map(loaded(path).encode)

    return df.withColumn(out_col, ids(F.col(text_col)))


def decode_column(df: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the decoded text of an array of ids; a null array gives an empty text."""

    @F.pandas_udf("string")
    def text(s):  # noqa: ANN001, ANN202
        return s.map(lambda x: loaded(path).decode([] if x is None else [int(i) for i in x]))

    return df.withColumn(out_col, text(F.col(ids_col)))


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row; ids may be null or repeated, and other columns are ignored."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            found = [bpe.digests(t) for t in b.column("text").to_pylist()]
            cols = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        rows, f"id {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
