"""Alignment of two tokenizers over a corpus: which tokens end together, and how often each pair of ids does.

A is a byte-level BPE on space + text, B a piece BPE that adds the space itself; special strings inside texts are plain text. A text's bytes are cut
into groups where a token of A and a token of B end together; the two tokens that end there are a link.

Texts are cut into chunks at single spaces between two other characters. At such a place both encoders cut whatever stands around it: A's pre-tokens take a
space only in front of what follows or in runs of white space, and no piece of B has its space sign after another character, which is checked for the
file. Each distinct chunk is encoded once per worker, with both, and its groups and links are kept. A chunk that does not give its own bytes back leaves its text without
tokens, as does a text that holds B's space sign itself.

A link is a packed number of 64 bits, the id of B above the id of A. Each text keeps its distinct links with how often it has them, as a compressed
run. Counts are partial per task (np.unique), range-partitioned, sorted by Spark within the ranges, and summed by run lengths; each
range is a shard of sorted keys and counts, written to the shared folder. Texts look their links up with searchsorted in the shards,
which are memory-mapped where the shared folder is a mounted one and read one at a time where it is not, so a task holds no table. What the driver sees is a
row for each shard and each id of B with its highest count.

Null and empty texts, and texts whose tokens don't give back their bytes, have zeros and an empty `groups_sha256`. Of equal counts of an id of B all are its highest. Repeated rows
count each, rows with a null doc_id too. Texts are read whole, however long. An empty table gives no rows. Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import runs
from cadenza.llm.shared import discard, lean, materialize, rows_of, shared_dir, small_batches, text_column, text_slices, trim
from cadenza.llm.token_counts import _byte_letters, vocabulary_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Chunks that a worker keeps, code points of the longest that is kept, bytes of text that are encoded together, chunks that are encoded in one call.
CACHE, KEPT, RUN, CALL = 400_000, 64, 2 << 20, 20_000
#: Distinct links that a task gathers before it sends their counts, links of all texts that are looked up together, and rows of a shard at most, about.
GATHERED, TOGETHER, SHARD = 1 << 21, 1 << 21, 4_000_000
SIGN = "▁"
#: Signs after a word that are a pre-token of A by themselves.
_SIGNS = (".", ",", ";", ":", "!", "?")
#: A chunk: what follows its space up to the next single space between two characters that are no white space.
_CHUNK = re.compile(r"(?:\A\s+| )\S*(?:(?:\s\s+|[^\S ]|\s\Z)\S*)*")


class Aligner:
    """Chunks of space + text as (ids, groups, links) of two vocabulary files."""

    def __init__(self, a: str, b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letters = _byte_letters()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{SIGN}]{SIGN}", p) for p in pieces):
            raise ValueError("a piece of B spans words: texts cannot be cut at spaces")
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = list(map(str, range(len(self.a_bytes)))), list(map(str, range(len(pieces))))
        self.letter = {b: c for c, b in letters.items()}
        self.merge = self.a.model.tokenize
        self.clear()

    def clear(self) -> None:
        """Forget all chunks."""
        self.place: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.links: list[bytes] = []  # 64-bit numbers
        self.numbers = np.zeros((0, 3), np.int64)  # n_a, n_b, n_groups; n_a is -1 where bytes differ

    def forget(self, first: int) -> None:
        """Forget the chunks that were learned from place `first` on."""
        self.place = {c: i for c, i in self.place.items() if i < first}
        del self.groups[first:], self.links[first:]
        self.numbers = self.numbers[:first]

    def learn(self, chunks: list[str]) -> None:
        for lo in range(0, len(chunks), CALL):
            part = chunks[lo : lo + CALL]
            known = [self._merged(c) for c in part]
            rest = iter(self.a.encode_batch([c for c, a in zip(part, known, strict=True) if a is None], add_special_tokens=False))
            a = [next(rest).ids if x is None else x for x in known]
            b = self.b.encode([c[1:] for c in part], num_threads=1)
            own = [c.encode("utf-8", "replace") for c in part]
            differ = [SIGN in c for c in part]
            for names, ids in ((self.a_bytes, a), (self.b_bytes, b)):
                if b"".join([names[i] for x in ids for i in x]) != b"".join(own) or [sum([len(names[i]) for i in x]) for x in ids] != list(map(len, own)):
                    differ = [d or b"".join([names[i] for i in x]) != o for d, x, o in zip(differ, ids, own, strict=True)]
            good = [k for k, d in enumerate(differ) if not d]
            numbers = np.full((len(part), 3), (-1, 0, 0), np.int64)
            groups, links = [b""] * len(part), [b""] * len(part)
            if good:
                self._group([a[k] for k in good], [b[k] for k in good], [own[k] for k in good], good, numbers, groups, links)
            self.place.update(zip(part, range(len(self.groups), len(self.groups) + len(part)), strict=True))
            self.groups += groups
            self.links += links
            self.numbers = np.concatenate([self.numbers, numbers])

    def _group(self, a: list[list[int]], b: list[list[int]], own: list[bytes], at: list[int], numbers: np.ndarray, groups: list[bytes], links: list[bytes]) -> None:
        """Fill in the numbers, groups and links of chunks whose tokens give back their bytes, at the places `at`; ends are found for all chunks together."""
        flat_a, flat_b = [i for x in a for i in x], [i for x in b for i in x]
        ends_a, ends_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        place = np.searchsorted(ends_a, ends_b)
        shared = np.flatnonzero(ends_a[place] == ends_b)
        linked = ((np.array(flat_b, np.int64)[shared] << 32) | np.array(flat_a, np.int64)[place[shared]]).tobytes()
        names_a, names_b = [self.a_name[i] for i in flat_a], [self.b_name[i] for i in flat_b]
        texts, last_a, last_b = [], 0, 0
        for i, j in zip((place[shared] + 1).tolist(), (shared + 1).tolist(), strict=True):
            texts.append(",".join(names_a[last_a:i]) + "|" + ",".join(names_b[last_b:j]))
            last_a, last_b = i, j
        ends = np.searchsorted(ends_b[shared], np.cumsum(list(map(len, own))), "right")
        numbers[at] = np.stack([list(map(len, a)), list(map(len, b)), np.diff(ends, prepend=0)], axis=1)
        first = 0
        for k, end in zip(at, ends.tolist(), strict=True):
            groups[k], links[k] = ";".join(texts[first:end]).encode(), linked[8 * first : 8 * end]
            first = end

    def _merged(self, chunk: str) -> list[int] | None:
        """A's ids of a space and letters of U+00FF at most, with or without one sign after them: pre-tokens that need no search, merged by A's model; None for all others."""
        word, sign = (chunk[:-1], chunk[-1]) if chunk[-1:] in _SIGNS else (chunk, "")
        if not word[1:].isalpha():
            return None
        if word.isascii():
            spelled = self.letter[32] + word[1:]
        elif max(word) > "\u00ff":
            return None
        else:
            spelled = "".join([self.letter[b] for b in word.encode()])
        ids = [t.id for t in self.merge(spelled)]
        return ids + [t.id for t in self.merge(sign)] if sign else ids

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, list[int], np.ndarray]]:
        """n_a, n_b, n_groups, groups_sha256, links of each text."""
        cut = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        if len(self.place) > CACHE:
            self.clear()
        place = self.place
        new = {c for chunks in cut for c in chunks if c not in place}
        self.learn([c for c in new if len(c) <= KEPT])
        known = len(self.groups)
        self.learn([c for c in new if len(c) > KEPT])
        numbers, groups, links = self.numbers, self.groups, self.links
        for chunks in cut:
            at = [place[c] for c in chunks]
            n = numbers[at]
            if not at or (n[:, 0] < 0).any():
                yield 0, 0, 0, "", np.zeros(0, np.int64)
                continue
            digest = hashlib.sha256(b";".join([groups[i] for i in at])).hexdigest()
            yield *n.sum(axis=0).tolist(), digest, np.frombuffer(b"".join([links[i] for i in at]), np.int64)
        if len(groups) > known:
            self.forget(known)


@lru_cache(maxsize=2)
def aligner(a: str, b: str) -> Aligner:
    """One aligner per worker process and pair of files."""
    return Aligner(a, b)


def align(documents: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links (distinct ones with how often each, as a run; null if none) of every document."""
    small_batches(documents.sparkSession)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        for batch in batches:
            column = text_column(batch)
            for lo, hi, *_ in text_slices(column, RUN):
                rows = []
                for n_a, n_b, n_groups, digest, links in own.align(column.slice(lo, hi - lo).to_pylist()):
                    values, n = runs.counted(links.view(np.uint64))
                    rows.append((n_a, n_b, n_groups, len(links), digest, runs.pack(runs.steps(values), n) if len(links) else None))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return rows_of(documents).mapInArrow(lean(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    differences, n = runs.unpack(blob, 2)
    return np.cumsum(differences, dtype=np.uint64).view(np.int64), n.view(np.int64)


def link_counts(aligned: DataFrame) -> DataFrame:
    """link, n: partial counts of each task; a link has a row for each task at most that gathered it, and more only for each GATHERED links."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, n, size = [], [], 0

        def sent() -> pa.RecordBatch:
            links, of = np.unique(np.concatenate(values), return_inverse=True)
            sums = np.bincount(of, np.concatenate(n)).astype(np.int64)  # exact below 2**53
            return pa.RecordBatch.from_arrays([pa.array(links), pa.array(sums)], names=["link", "n"])

        for batch in batches:
            for blob in batch.column(0):
                links, times = _unpacked(blob.as_py())
                values.append(links)
                n.append(times)
                size += len(links)
                if size >= GATHERED:
                    yield sent()
                    values, n, size = [], [], 0
        if size:
            yield sent()

    return aligned.where("links is not null").select("links").mapInArrow(lean(count), "link long, n long")


def shard_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, as an address that pyarrow opens: mounted, or a store that it knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"file://{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_shards(counts: DataFrame, folder: str, shard: int = SHARD) -> pa.Table:
    """File, first and last link of each sorted shard, with a row for each id of B in it and its highest count; counts: link, n, several rows a link.

    Columns name, first, last, b, most. A task sums the runs of its range as they come and writes them under a name of its own; only names of tasks that ended are used.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(links: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            store, path = _store(folder)
            name = f"{uuid.uuid4().hex}.links"
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(np.concatenate([links, n]).tobytes())
            b = links >> 32
            starts = runs.starts_of(b)
            columns = [[name] * len(starts), np.full(len(starts), links[0]), np.full(len(starts), links[-1]), b[starts], np.maximum.reduceat(n, starts)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "first", "last", "b", "most"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            links, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            at = runs.starts_of(links)
            return links[at], np.add.reduceat(n, at)

        parts, size = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                size += batch.num_rows
            if size >= shard:
                links, n = merged()
                if len(links) > shard // 2:  # the last link may go on
                    yield rows(links[:-1], n[:-1])
                    links, n = links[-1:], n[-1:]
                parts, size = [(links, n)], len(links)
        if parts:
            yield rows(*merged())

    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(parts, "link").sortWithinPartitions("link")
    return dealt.mapInArrow(lean(write), "name string, first long, last long, b long, most long").toArrow()


def look_up(aligned: DataFrame, folder: str, shards: list[tuple[str, int, int]], highest: np.ndarray) -> DataFrame:
    """aligned with n_best and count_sum in place of the links."""
    sent = aligned.sparkSession.sparkContext.broadcast((shards, highest))  # a row a shard, a number for each id of B

    def find(links: np.ndarray) -> np.ndarray:
        """The count of each of a sorted array of links, shard by shard."""
        out = np.zeros(len(links), np.int64)
        store, path = _store(folder)
        for name, first, last in sent.value[0]:
            lo, hi = np.searchsorted(links, [first, last + 1])
            if lo == hi:
                continue
            mapped = np.memmap(f"{path}/{name}", np.int64, "r") if isinstance(store, fs.LocalFileSystem) else np.frombuffer(store.open_input_file(f"{path}/{name}").read(), np.int64)
            keys, n = mapped[: len(mapped) // 2], mapped[len(mapped) // 2 :]
            out[lo:hi] = n[np.searchsorted(keys, links[lo:hi])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(blob.as_py() or b"") for blob in batch.column(6)]
            cuts, held = [0], 0
            for i, size in enumerate(sizes):
                held += size
                if held >= TOGETHER:
                    cuts.append(i + 1)
                    held = 0
            cuts = sorted({*cuts, len(sizes)})
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                best, sums = texts(batch.column(6).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:6]), pa.array(best), pa.array(sums)], names=[*batch.schema.names[:6], "n_best", "count_sum"])

    def texts(blobs: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        each = [_unpacked(blob) if blob else (np.zeros(0, np.int64),) * 2 for blob in blobs]
        links, n = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*each, strict=True))
        distinct, back = np.unique(links, return_inverse=True)
        counts = find(distinct)
        best = (counts == sent.value[1][distinct >> 32])[back]
        ends = np.cumsum([len(x) for x, _ in each])
        sums = [np.append(0, np.cumsum(x)) for x in (n * best, n * counts[back])]
        return tuple(np.diff(np.append(0, x[ends])) for x in sums)

    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return aligned.mapInArrow(lean(run), kinds)


def cross_align(documents: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every document."""
    spark = documents.sparkSession
    aligned = materialize(align(documents, a or vocabulary_path(A), b or vocabulary_path(B)), "aligned", compression="zstd")
    counts = materialize(link_counts(aligned), "link-counts", compression="zstd")
    folder = shard_folder(spark)
    found = write_shards(counts, folder)
    trim()
    name, first, last, ids, most = (found.column(i).to_numpy() for i in range(5))
    shards = sorted({(x, int(y), int(z)) for x, y, z in zip(name, first, last, strict=True)}, key=lambda s: s[1])
    highest = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    np.maximum.at(highest, ids, most)
    out = materialize(look_up(aligned, folder, shards, highest), "cross-aligned")
    discard(aligned, counts)
    if shards:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    return cross_align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
