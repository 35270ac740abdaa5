"""Token counts by the whole-token shortcut.

Offline, every vocabulary string that ends a word is encoded alone; those that come back as exactly their own
id are proven whole tokens. A run of texts is cut at white space with vectorised hashing; each distinct piece is
looked at once. Plain pieces (printable U+0000-U+00FF without an apostrophe, at most KEPT bytes) are cut into pre-tokens and merged together,
as arrays, by `pair_merges.py`. Of the other pieces, pre-tokens that are proven count directly, the rest is merged by the library's model.
Results are those of the library on the whole text:

* white space separates pre-tokens, and neither NFC nor lower-casing reaches across it, so pieces are independent;
* a piece inside printable U+0000-U+00FF is lower-cased by Python or by table, which there equals the tokenizer's normaliser;
* without an apostrophe, pre-tokens are runs of letters, runs of other signs, and single digits;
* a piece with any other character goes through the library as it is;
* a text that holds the opening of a special string goes through the library whole.

Pieces of one hash are held to be one piece only after their bytes were compared; a run with two pieces of one hash goes
through the library.

Null and empty texts have no tokens. Repeated rows are counted each, rows with a null doc_id too. Texts are counted whole, however long, and so are
pieces without any white space. An empty table gives no rows. Columns besides doc_id and text are ignored, whatever their names.
Pieces that are not plain and were seen before are kept in a dictionary of at most CACHE entries of at most KEPT bytes per worker, the older half of
which is dropped when it is full.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.pair_merges import PairMerges, spread
from cadenza.llm.shared import lean, offsets_of, small_batches, text_column, text_slices
from cadenza.llm.words import word_spans

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CACHE, KEPT = 250_000, 64
#: Bytes of text whose distinct pieces are found together.
RUN = 4 << 20
#: Plain pieces that are merged together.
TOGETHER = 1 << 15
#: Characters that pieces on the fast path may have: printable ASCII, letters and signs from U+00A1 without the soft hyphen.
_SAFE = bytes([*range(0x20, 0x7F), *(x for x in range(0xA1, 0x100) if x != 0xAD)])


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Shortcut:
    """Encoder of one vocabulary file; ids(text) as little-endian 32-bit bytes, count(text) as a number."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pretokens = regex.compile(pattern).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.opening = os.path.commonprefix(self.special).encode() or None
        self.whole = self._prove(model["vocab"])
        self.letters = {b: c for c, b in _byte_letters().items()}
        self.model = self.tokenizer.model
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        plain = plain and all(c + end in model["vocab"] for c in self.letters.values() for end in ("", self.suffix))
        self.merges = PairMerges(model["vocab"], model["merges"], self.suffix, self.letters) if plain else None
        self.cache: dict[bytes, bytes] = {}

    def _prove(self, vocab: dict[str, int]) -> dict[str, bytes]:
        """Vocabulary strings that, encoded alone, are one pre-token and exactly their own id."""
        table = _byte_letters()
        names, ids = [], []
        for name, i in vocab.items():
            body = name.removesuffix(self.suffix) if self.suffix else name
            if (self.suffix and body == name) or name in self.special or any(c not in table for c in body):
                continue
            try:
                text = bytes(table[c] for c in body).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if self.pretokens(text) == [text]:
                names.append(text)
                ids.append(i)
        encoded = self.tokenizer.encode_batch(names, add_special_tokens=False)
        return {t: i.to_bytes(4, "little") for t, i, e in zip(names, ids, encoded, strict=True) if e.ids == [i]}

    def _library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pretoken(self, p: str) -> bytes:
        ids = self.whole.get(p)
        if ids is None:
            word = p if p.isascii() else "".join([self.letters[b] for b in p.encode("utf-8")])
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])
        return ids

    def _learn(self, piece: bytes) -> bytes:
        """The ids of a piece without white space: proven pre-tokens directly, the rest merged."""
        text = piece.decode("utf-8", "replace")
        try:
            safe = not text.encode("latin-1").translate(None, _SAFE)
        except UnicodeEncodeError:
            safe = False
        if not safe:
            return self._library(text)
        text = text.lower()
        if text.isalpha():
            return self._pretoken(text)
        stem, last = text[:-1], text[-1]
        if stem.isalpha() and last in ",.":
            return (self.cache.get(stem.encode()) or self._pretoken(stem)) + self._pretoken(last)
        return b"".join(map(self._pretoken, self.pretokens(text)))

    def _distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each piece begin, number of each) of distinct pieces of `data`: plain ones together, the others one by one."""
        plain = np.zeros(len(starts), bool)
        lens = np.zeros(len(starts), np.int64)
        parts = [np.zeros(0, "<u4")]
        short = np.flatnonzero(ends - starts <= KEPT)
        for some in (short[k : k + TOGETHER] for k in range(0, len(short) if self.merges else 0, TOGETHER)):
            text, begins, of, safe = plain_words(data, starts[some], ends[some])
            ids, n = self.merges.encode(text, begins)
            parts.append(ids)
            plain[some[safe]] = True
            lens[some] = np.bincount(of, n, len(some))
        ids = np.concatenate(parts)
        at = np.cumsum(lens) - lens
        others = np.flatnonzero(~plain)
        cache, values = self.cache, []
        if len(cache) > CACHE:
            for k in list(islice(cache, len(cache) // 2)):
                del cache[k]
        for a, b in zip(starts[others].tolist(), ends[others].tolist(), strict=True):
            piece = data[a:b].tobytes().lower()
            found = cache.get(piece)
            if found is None:
                found = self._learn(piece)
                if len(piece) <= KEPT:
                    cache[piece] = found
            values.append(found)
        lens[others] = np.fromiter(map(len, values), np.int64, len(values)) // 4
        at[others] = len(ids) + np.cumsum(lens[others]) - lens[others]
        return np.concatenate([ids, np.frombuffer(b"".join(values), "<u4")]), at, lens

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each) of a run of texts given as bytes and offsets."""
        raw = data.tobytes()
        special = [d for d in range(len(offs) - 1) if raw.find(self.opening, offs[d], offs[d + 1]) >= 0] if self.opening and self.opening in raw else []
        hashes, starts, ends = word_spans(data, offs)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if not same_pieces(data, starts, ends, first, inverse):
            ids = [np.frombuffer(self._library(raw[a:b].decode("utf-8", "replace")), "<u4") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            return np.concatenate([*ids, np.zeros(0, "<u4")]), np.array([len(x) for x in ids], np.int64)
        ids, at, lens = self._distinct(data, starts[first], ends[first])
        each = lens[inverse]
        ids = ids[spread(at[inverse], each)]
        bounds = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts, offs)]
        if special:
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for d in special:
                parts[d] = np.frombuffer(self._library(raw[offs[d] : offs[d + 1]].decode("utf-8", "replace")), "<u4")
            return np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, np.diff(bounds)


#: Upper-case ASCII letters have no part in a piece's hash: bytes are compared in lower case.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


#: What each of U+0000-U+00FF is in a plain piece: 0 not plain, 1 letter, 2 number, 3 other sign.
_KIND = np.array([0 if b not in _SAFE or b in b" '" else {"L": 1, "N": 2}.get(unicodedata.category(chr(b))[0], 3) for b in range(256)], np.uint8)


def plain_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes of all plain pieces end to end, where each pre-token begins, the number of its piece, whether each piece is plain)."""
    size = ends - starts
    at = np.cumsum(size) - size
    text = data[spread(starts, size)]
    before, after = np.append(np.uint8(0), text[:-1]), np.append(text[1:], np.uint8(0))
    before[at], after[at + size - 1] = 0, 0
    tail = (text & 0xC0) == 0x80  # the second byte of a character
    code = np.where(tail, text | ((before & 1) << 6), text)  # U+0080-U+00BF begin with 0xC2, U+00C0-U+00FF with 0xC3
    kind = np.where(tail & ((before & 0xFE) == 0xC2), _KIND[code], np.where(text < 0x80, _KIND[text], 0))
    head = ((text & 0xFE) == 0xC2) & ((after & 0xC0) == 0x80)
    kind[head] = kind[np.flatnonzero(head) + 1]
    text = np.where(tail & (before == 0xC3) & (text <= 0x9E) & (text != 0x97), text | 0x20, _LOWER[text])
    safe = np.minimum.reduceat(kind, at) > 0
    begin = ~tail & ((kind == 2) | (kind != np.append(np.uint8(0), kind[:-1])))
    begin[at] = True
    keep = np.repeat(safe, size)
    text, begins = text[keep], np.flatnonzero(begin[keep])
    return text, begins, np.repeat(np.arange(len(size)), size)[keep][begins], safe


def same_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, inverse: np.ndarray) -> bool:
    """Whether every piece has the bytes of the first one of its hash, in lower case; eight bytes of all pieces are compared at a time."""
    size = ends - starts
    if not len(size) or (size != size[first][inverse]).any():
        return not len(size)
    padded = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    rest, at, of = size, starts, starts[first][inverse]
    while len(rest):
        mask = np.where(rest >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * np.minimum(rest, 7)).astype(np.uint64)) - np.uint64(1))
        if ((eights[at] ^ eights[of]) & mask).any():
            return False
        more = rest > 8
        rest, at, of = rest[more] - 8, at[more] + 8, of[more] + 8
    return True


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Shortcut:
    """One encoder per worker process and file."""
    return Shortcut(path)


def count_tokens(documents: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, with the tokens the library would give."""
    small_batches(documents.sparkSession)
    path = path or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shortcut = encoder(path)
        for batch in batches:
            column = text_column(batch)
            n = [shortcut.encode(data, offs)[1] for _, _, data, offs in text_slices(column, RUN)]
            n = np.concatenate([*n, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets_of(column)[1])), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
