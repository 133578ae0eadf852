"""Packing by lexical retrieval: a sharded BM25 index returns unused neighbours, which fill a seed's window."""

from __future__ import annotations

import json
import os
import string
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release, saved

WINDOW, END = 2048, 1
K1, B, TERMS = 1.2, 0.75, 24  # BM25's parameters; terms of a seed that are looked up
SHARD = 1 << 21  # tokens in a shard, about
CACHED, SHORT = 400_000, 64  # stretches without space whose ids a worker keeps, and their characters at most
WIDE = r"[^\x{0}-\x{12f}\x{131}-\x{17f}]|<\|"
POINTS = string.punctuation


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: By a tokenizer's path: the tokenizer, and the ids that this worker knows; they outlast a task.
_LOADED: dict[str, tuple] = {}


def _rules(path: str) -> tuple:
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    return d["normalizer"], d["pre_tokenizer"], d["post_processor"], d["model"]["type"], {k: v for k, v in d["model"].items() if k not in ("vocab", "merges")}


def _tokenize(path: str, batches):
    """By words, for tokenizers with the rules of the usual one (see below); any other encodes whole texts."""
    if _rules(path) == _rules(tokenizer_path()):
        yield from _tokenize_words(path, batches)
        return
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    code = "H" if tok.get_vocab_size() <= 1 << 16 else "I"
    for b in batches:
        ids = [array(code, [*tok.encode(t or "", add_special_tokens=False).ids, END]) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n", "ids"])


def _tokenize_words(path: str, batches):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = (Tokenizer.from_file(path), {"": b""}, {})
    tok, known, before = _LOADED[path]
    code = "H" if tok.get_vocab_size() <= 1 << 16 else "I"
    end, size = array(code, [END]).tobytes(), array(code).itemsize
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
    mark = tok.id_to_token(tok.get_vocab_size() - 1)  # a special token: ends a word, and is kept apart
    cut = tok.token_to_id(mark)
    model, letters = tok.model, _Letters()

    def learn(words: set[str]) -> None:
        """Lower-case Latin words are a matter of the model alone; others go through all of the tokenizer."""
        rest = []
        for w in words:
            if w.isalpha() and w.islower() and max(w) < "\u0180":
                known[w] = array(code, [t.id for t in model.tokenize(w if w.isascii() else w.translate(letters))]).tobytes()
            else:
                rest.append(w)
        for i in range(0, len(rest), 2000):
            some = rest[i : i + 2000]
            ids = np.array(encode([mark.join(some)], add_special_tokens=False)[0].ids, code)
            ends = np.append(np.flatnonzero(ids == cut), len(ids)).tolist()
            if len(ends) != len(some):
                raise ValueError("words and ids differ in number")
            raw = ids.tobytes()
            known.update((w, raw[x * size : y * size]) for w, x, y in zip(some, [0, *(y + 1 for y in ends)], ends))

    release()
    for b in batches:
        # this tokenizer drops white space and no token crosses it, so what stands between spaces is encoded
        # alone, each different word once; Arrow finds them and numpy puts the ids in their places
        words = pc.split_pattern(_lowered(pc.fill_null(b.column("text"), "")), " ")
        coded = words.flatten().dictionary_encode()
        parts = coded.dictionary.to_pylist()
        if len(known) > CACHED:  # what isn't used for as long again goes
            before.clear()
            before.update(known)
            known.clear()
            known[""] = b""
        found = list(map(known.get, parts))
        gaps = [i for i, x in enumerate(found) if x is None]
        known.update((p, x) for p in (parts[i] for i in gaps) if (x := before.get(p)) is not None)
        new = [p for p in (parts[i] for i in gaps) if p not in known]
        # nor does one cross from letters to punctuation
        ends = {p: len(q) for p in new if p[-1] in POINTS and (q := p.rstrip(POINTS)) and q[-1] < "\u0180" and q[-1].isalpha() and q[-1] != "\u0130" and "<|" not in p}
        plain = {p for p in new if p not in ends}
        for p, n in ends.items():
            plain.update(q for q in (p[:n], p[n:]) if q not in known)
        for p in [p for p in plain if "<|" in p]:
            plain.discard(p)
            known[p] = array(code, encode([p], add_special_tokens=False)[0].ids).tobytes()
        learn(plain)
        known.update((p, known[p[:n]] + known[p[n:]]) for p, n in ends.items())
        for i in gaps:
            found[i] = known[parts[i]]
        sizes = np.array([len(x) for x in found], np.int64) // size
        which = coded.indices.to_numpy()
        n = sizes[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(((np.cumsum(sizes) - sizes)[which] - upto[:-1]).astype(np.int32), n)  # a batch is far below 2**31 ids
        at += np.arange(upto[-1], dtype=np.int32)
        ids = np.frombuffer(b"".join(found), code)[at]
        ends = upto[words.offsets.to_numpy() - words.offsets[0].as_py()]
        for p in {p for p in (*new, *plain) if len(p) > SHORT}:
            known.pop(p, None)
        out = [ids[x:y].tobytes() + end for x, y in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(ends) + 1), pa.array(out, pa.binary())], ["doc_id", "n", "ids"])


class _Letters(dict):
    """For str.translate: letters as the tokenizer writes their bytes."""

    def __missing__(self, c: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel

        self[c] = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0]
        return self[c]


def _lowered(texts: pa.Array) -> pa.Array:
    """White space as spaces; in lower case as the tokenizer makes it itself, where that is a matter of single
    letters: fewer different words to encode."""
    for c in "\n\t\r":
        texts = pc.replace_substring(texts, c, " ")
    return pc.if_else(pc.match_substring_regex(texts, WIDE), texts, pc.utf8_lower(texts))


def _ids(row: bytes, n: int) -> np.ndarray:
    return np.frombuffer(row, f"<u{len(row) // n}")


def _frequencies(vocab: int, batches):
    counts, docs, tokens, last = np.zeros(vocab, np.int64), 0, 0, np.zeros(vocab, np.int64)
    for b in batches:
        for n, row in zip(b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
            ids, at = _ids(row, n), np.arange(n)
            last[ids] = at
            counts[ids[last[ids] == at]] += 1  # each id where it comes last
            docs, tokens = docs + 1, tokens + n
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([used, [-1, -2]])), pa.array(np.concatenate([counts[used], [docs, tokens]]))], ["term", "n"])


def _routes(model, shards, batches):
    """Adds to each document its route, the term that weighs most in it by BM25, and with shards its shard."""
    idf, average = model.value
    count = TaskContext.get().partitionId() * 7919
    for b in batches:
        routes = []
        for n, row in zip(b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
            terms, tf = np.unique(_ids(row, n), return_counts=True)
            routes.append(terms[(idf[terms] * tf / (tf + K1 * (1 - B + B * n / average))).argmax()])
        at = np.array(routes, np.int64)
        if shards:
            first, parts = (x[at] for x in shards.value)
            at = first + (count + np.arange(len(at))) % parts
            count += len(at)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*b.schema.names, "shard" if shards else "route"])


def deal(sums: dict[int, int], vocab: int, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """By route its first shard and the number of its shards, and the number of all: routes of few tokens share a
    shard of about `size`, one of more gets as many as it needs."""
    first, parts = np.zeros(vocab, np.int64), np.ones(vocab, np.int64)
    shards, room = 0, 0
    for term, n in sorted(sums.items()):
        if n > size:
            first[term], parts[term] = shards, -(-n // size)
            shards, room = shards + int(parts[term]), 0
        else:
            if n > room:
                shards, room = shards + 1, size
            first[term] = shards - 1
            room -= n
    return first, parts, shards


class Index:
    """BM25's inverted index over the documents of one shard; counts and lengths come from all shards."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, average: float):
        terms, counts = zip(*(np.unique(d, return_counts=True) for d in docs), strict=True) if docs else ((), ())
        self.terms = terms
        length = np.array([len(d) for d in docs], float)
        owner = np.repeat(np.arange(len(docs)), [len(t) for t in terms])
        term = np.concatenate(terms) if docs else np.zeros(0, np.int64)
        tf = np.concatenate(counts) if docs else np.zeros(0)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / average)) if docs else tf
        self.best = []  # of each document the terms that weigh most in it
        at = 0
        for t in terms:
            w = weight[at : at + len(t)]
            at += len(t)
            self.best.append(t[np.argsort(-w, kind="stable")[:TERMS]])
        order = np.argsort(term, kind="stable")
        self.owner, self.weight, term = owner[order], weight[order], term[order]
        self.starts = np.searchsorted(term, np.arange(len(idf) + 1))

    def scores(self, doc: int, n: int) -> np.ndarray:
        found = np.zeros(n)
        for t in self.best[doc]:
            at = slice(self.starts[t], self.starts[t + 1])
            found[self.owner[at]] += self.weight[at]
        return found


def fill(docs: list[np.ndarray], idf: np.ndarray, average: float, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that pack one shard without padding.

    Whole windows of long documents stand alone. What remains of each document is packed: the longest
    unused one is the seed, its neighbours by BM25 follow in order of score if they fit, and the best of
    those that don't is cut to fill the rest. A last window that isn't full is cut into powers of two.
    """
    index = Index(docs, idf, average)
    seq = 0
    start = np.array([len(d) // window * window for d in docs], np.int64)
    left = np.array([len(d) for d in docs], np.int64) - start
    for i, s in enumerate(start):
        for at in range(0, s, window):
            yield i, at, window, seq, 0
            seq += 1
    while left.any():
        seed = int(left.argmax())
        pieces = [(seed, int(start[seed]), int(left[seed]))]
        room = window - int(left[seed])
        left[seed] = 0
        if room:
            score = index.scores(seed, len(docs))
            unused = np.flatnonzero(left)
            ranked = unused[np.argsort(-score[unused], kind="stable")]
            sizes = left[ranked]
            i = 0
            while room and i < len(ranked):  # jumps to the next neighbour that fits
                fits = np.flatnonzero(sizes[i:] <= room)
                if not len(fits):
                    break
                i += int(fits[0])
                pieces.append((int(ranked[i]), int(start[ranked[i]]), int(sizes[i])))
                room -= int(sizes[i])
                left[ranked[i]] = 0
                i += 1
            over = ranked[left[ranked] > 0] if room else ()
            if len(over):
                pieces.append((int(over[0]), int(start[over[0]]), room))
                start[over[0]] += room
                left[over[0]] -= room
                room = 0
        offset, total = 0, window - room
        ends = [window] if not room else list(np.cumsum([1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]))
        base = 0
        for doc, at, size in pieces:
            while size:
                take = min(size, int(ends[0]) - base - offset)
                yield doc, at, take, seq, offset
                at, size, offset = at + take, size - take, offset + take
                if base + offset == ends[0]:
                    base, offset, seq = int(ends.pop(0)), 0, seq + 1


def _pack(model, batches):
    idf, average = model.value
    held: list = []
    shard = None

    def done():
        docs = [_ids(row, n) for _, n, row in held]
        rows = list(fill(docs, idf, average))
        crc = [zlib.crc32(docs[i][at : at + size].astype("<u4").tobytes()) for i, at, size, _, _ in rows]
        i, at, size, seq, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        ids = [held[k][0] for k in i]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.array([h[1] for h in held], np.int64)[i]), pa.array((shard << 32) + seq), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    for b in batches:
        for s, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "n", "ids")), strict=True):
            if s != shard and held:
                yield done()
                held = []
            shard = s
            held.append(row)
    if held:
        yield done()


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n (ids, the closing one included), ids (little-endian, 2 bytes each
    if the vocabulary allows, else 4). A null text is empty and has the closing id only."""
    bounded_batches(docs.sparkSession, 3000)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_tokenize, path or tokenizer_path()), "doc_id long, n long, ids binary")


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs: doc_id, text; other columns are ignored. Returns pieces doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset: each id of each row lies in one piece, sequences hold 2048 ids or a smaller power of two.

    Rows that repeat a doc_id, a null one included, are documents of their own; null, empty and blank texts
    are one id long. An empty table gives an empty result.

    Document frequencies (one number for each id of the vocabulary), the number of documents and their mean
    length are of all documents. Documents go to shards of about 2M ids by content, the term that weighs most
    in them, so that neighbours tend to meet at any number of shards; a term with more tokens than a shard holds,
    as of a group of copies, is dealt out over several in turn. A shard's index and windows need its own
    documents only.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or tokenizer_path()
    rows = saved(tokenize(docs, path), "ids")
    vocab = Tokenizer.from_file(path).get_vocab_size()
    counts = {r.term: r.n for r in rows.mapInArrow(partial(_frequencies, vocab), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # vocab + 2 rows at most
    n, tokens = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(vocab)
    df[list(counts)] = list(counts.values())
    model = spark.sparkContext.broadcast((np.log1p((n - df + 0.5) / (df + 0.5)), max(1.0, tokens / max(1, n))))
    kind = "doc_id long, n long, ids binary"
    sums = {r.route: r.n for r in rows.mapInArrow(partial(_routes, model, None), f"{kind}, route long").groupBy("route").agg(F.sum("n").alias("n")).collect()}  # vocab rows at most
    first, parts, shards = deal(sums, vocab, SHARD)
    dealt = spark.sparkContext.broadcast((first, parts))  # two numbers for each id of the vocabulary
    d = rows.mapInArrow(partial(_routes, model, dealt), f"{kind}, shard long")
    d = d.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "doc_id", F.crc32("ids"))
    return d.select("shard", "doc_id", "n", "ids").mapInArrow(partial(_pack, model), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_bm25_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
