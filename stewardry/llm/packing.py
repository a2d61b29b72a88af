"""Filling fixed-capacity containers with documents by lexical retrieval.

The largest unused documents seed containers; their unused neighbours by BM25,
best score first, fill the window: while several fit the best one is taken, and
a neighbour that closes the window almost exactly is preferred. The inverted index
is in shards of bounded size. Documents are co-located by content, not by chance:
they fall into cells around centroids, and a shard is a group of similar cells, so
that a seed's neighbours lie in its own shard. Of a container that is not filled
well the smallest member is released, and these and the rests of such containers are
packed by best fit, largest first, across shards.

Only a document larger than the container is cut: into full containers and one
rest, which is packed like a document.

Defined cases: sizes are bytes of the UTF-8 text plus one end token, a null text
counts as empty (size 1); a spec with null source takes all documents, a
document with null source belongs to no named source; sources compare without
case and outer blanks; a spec without documents gives no rows; rows are packed one
by one, so repeated rows are repeated; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stewardry.llm.mixing import source_key, tokens
from stewardry.runtime import cut

#: Slots of the table of document frequencies: its size is fixed whatever the vocabulary. Words themselves are told apart by 32 bits.
SLOTS = 1 << 20
K1, B = 1.2, 0.75

#: Documents are sketched in so many dimensions when they are put into cells; the centroids are fitted on at most so many documents.
SKETCH, FIT_DOCS, MAX_CELLS = 512, 20_000, 4096

_WORD = re.compile(r"\w+")
#: The identifier passes Python as text, which is exact and may be null.
_OUT = "pack_id bigint, container string, doc_id string, piece int, n_pieces int, start bigint, tokens bigint, capacity bigint"


class _Hashes(dict):
    """The 32-bit hash of a word, remembered; ``trim`` keeps the memory bounded."""

    def __missing__(self, word: str) -> int:
        made = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return made

    def trim(self) -> None:
        if len(self) > 500_000:
            self.clear()


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per document its distinct words as hashes and how often each occurs, as bytes; texts are read this once only."""
    known = _Hashes()
    for batch in batches:
        terms, counts = [], []
        for text in batch.pop("text"):
            tf = Counter(_WORD.findall(text.lower())) if text else {}
            terms.append(np.fromiter(map(known.__getitem__, tf), np.uint32, len(tf)).tobytes())
            counts.append(np.fromiter(tf.values(), np.uint32, len(tf)).clip(max=65535).astype(np.uint16).tobytes())
            known.trim()
        yield batch.assign(terms=terms, counts=counts)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id as text, key, size, terms, counts, item) of every row; the words are kept, the texts are not."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), source_key().alias("key"), tokens().cast("bigint").alias("size"), "text")
    return cut(rows.mapInPandas(_described, "doc_id string, key string, size bigint, terms binary, counts binary").withColumn("item", F.monotonically_increasing_id()))


def _postings(terms, counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the document, word, frequency) of all words of several documents."""
    length = np.fromiter((len(t) // 4 for t in terms), np.int64, len(terms))
    return np.repeat(np.arange(len(terms), dtype=np.int32), length), np.frombuffer(b"".join(terms), np.uint32), np.frombuffer(b"".join(counts), np.uint16).astype(np.float32)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: documents per slot, and under -1 and -2 the number of documents and of words."""
    df, docs, words = np.zeros(SLOTS, np.int64), 0, 0
    for batch in batches:
        _, term, n = _postings(batch["terms"].tolist(), batch["counts"].tolist())
        docs, words = docs + len(batch), words + int(n.sum())
        df += np.bincount(term & (SLOTS - 1), minlength=SLOTS)
    at = np.flatnonzero(df)
    yield pd.DataFrame({"slot": np.concatenate([at, [-1, -2]]), "n": np.concatenate([df[at], [docs, words]])})


class Weights:
    """BM25 weights of words in documents, by the frequencies and the mean length of the whole corpus."""

    def __init__(self, idf: np.ndarray, mean: float):
        self.idf, self.mean = idf, mean

    def of(self, terms, counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the document, word, weight) of all words of several documents."""
        doc, term, n = _postings(terms, counts)
        length = np.bincount(doc, n, len(terms)).astype(np.float32)
        return doc, term, self.idf[term & (SLOTS - 1)] * n * (K1 + 1) / (n + K1 * (1 - B + B * length[doc] / self.mean))

    def sketches(self, terms, counts) -> np.ndarray:
        """Documents as vectors of fixed width: words fall on dimensions and signs by their hashes."""
        doc, term, weight = self.of(terms, counts)
        mixed = term * np.uint32(0x9E3779B1)
        flat = doc.astype(np.int64) * SKETCH + (mixed >> np.uint32(8)) % SKETCH
        made = np.bincount(flat, np.where(mixed >> np.uint32(31), weight, -weight), len(terms) * SKETCH).reshape(-1, SKETCH).astype(np.float32)
        return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-6)


def corpus_statistics(known: DataFrame) -> Weights:
    """Document frequencies and mean length over all described documents; at most ``SLOTS + 2`` rows come to the driver."""
    sums = known.select("terms", "counts").mapInPandas(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(SLOTS)
    by = sums[sums.slot >= 0]
    df[by.slot.to_numpy()] = by.n.to_numpy()
    n, words = (int(sums.n[sums.slot == k].sum()) for k in (-1, -2))
    return Weights(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), max(words / max(n, 1), 1.0))


# --- shards of similar documents -----------------------------------------------------


def _fit(weights, cells: int):
    """Centroids of cells by spherical k-means over a bounded sample, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(batches), ignore_index=True).sort_values("at", ignore_index=True)
        x = weights.value.sketches(held["terms"].tolist(), held["counts"].tolist())
        r = np.random.default_rng(7)
        centre = x[r.choice(len(x), min(cells, len(x)), replace=False)].copy()
        for _ in range(8):
            own = np.argmax(x @ centre.T, axis=1)
            n = np.bincount(own, minlength=len(centre))
            for k in np.flatnonzero(n):
                centre[k] = x[own == k].mean(axis=0)
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-6)
        yield pd.DataFrame({"cell": range(len(centre)), "centre": [c.tobytes() for c in centre]})

    return run


def _put(weights, centre):
    """Adds to every document the cell of its nearest centroid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [np.argmax(weights.value.sketches(part["terms"].tolist(), part["counts"].tolist()) @ centre.value.T, axis=1) for part in (batch.iloc[a : a + 1024] for a in range(0, len(batch), 1024))]
            yield batch.assign(cell=np.concatenate([np.zeros(0, np.int32), *own]).astype(np.int32))

    return run


def _grouped(centre: np.ndarray, n: np.ndarray, size: np.ndarray, shard_docs: int, shard_bytes: int) -> list[list[int]]:
    """Cells in groups that a shard holds: halved along the direction in which the centroids differ most, until each group fits."""
    done, waiting = [], [np.flatnonzero(n)]
    while waiting:
        some = waiting.pop()
        if len(some) < 2 or n[some].sum() <= shard_docs and size[some].sum() <= shard_bytes:
            done.append(some.tolist())
            continue
        x = centre[some] - np.average(centre[some], axis=0, weights=n[some])
        along = x @ np.linalg.svd(x * np.sqrt(n[some])[:, None], full_matrices=False)[2][0]
        some = some[np.argsort(along, kind="stable")]
        share = np.cumsum(n[some]) / n[some].sum()
        at = int(np.clip(np.searchsorted(share, 0.5) + (share[np.searchsorted(share, 0.5)] < 0.55), 1, len(some) - 1))
        waiting += [some[:at], some[at:]]
    return [g for g in done if g]


def sharded(known: DataFrame, items: DataFrame, weights, shard_docs: int, shard_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """(described documents with their cell, (pack_id, cell, first, shards) of the tasks that need several shards, or None).

    A task of at most ``shard_docs`` documents and ``shard_bytes`` bytes is one shard.
    A single cell beyond that is cut by chance into as many shards as it needs.
    """
    spark = known.sparkSession
    totals = {r.pack_id: r for r in items.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()}
    big = {p: r for p, r in totals.items() if r.n > shard_docs or r.bytes > shard_bytes}
    if not big:
        return known.withColumn("cell", F.lit(0)), None
    needed = max(max(-(-r.n // shard_docs), -(-r.bytes // shard_bytes)) for r in big.values())
    most = max(r.n for r in totals.values())
    at = F.xxhash64("item")
    share = int(min(1.0, FIT_DOCS / most) * (1 << 40))
    sample = known.withColumn("at", at).where(F.pmod("at", F.lit(1 << 40)) < share).select("at", "terms", "counts")
    found = sample.repartition(1).mapInPandas(_fit(weights, min(MAX_CELLS, 48 * needed)), "cell int, centre binary").orderBy("cell").collect()
    centre = np.stack([np.frombuffer(r.centre, np.float32) for r in found])
    put = _put(weights, spark.sparkContext.broadcast(centre))
    placed = cut(known.mapInPandas(put, "doc_id string, key string, size bigint, terms binary, counts binary, item bigint, cell int").select("item", "cell"))
    counts: dict[int, list] = {}
    for r in items.where(F.col("pack_id").isin(list(big))).join(placed, "item").groupBy("pack_id", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect():
        counts.setdefault(r.pack_id, []).append(r)
    rows = []
    for pack, cells in counts.items():
        n, size = np.zeros(len(centre), np.int64), np.zeros(len(centre), np.int64)
        for r in cells:
            n[r.cell], size[r.cell] = r.n, r.bytes
        first = 0
        for group in _grouped(centre, n, size, shard_docs, shard_bytes):
            shards = int(max(-(-n[group].sum() // shard_docs), -(-size[group].sum() // shard_bytes)))
            rows += [(pack, c, first, shards) for c in group]
            first += shards
    where = spark.createDataFrame(rows, "pack_id bigint, cell int, first int, shards int")
    return known.mapInPandas(put, "doc_id string, key string, size bigint, terms binary, counts binary, item bigint, cell int"), where


# --- filling ---------------------------------------------------------------------------

#: Words that more than this share of a shard's documents hold are kept as rows of a matrix, up to so many; they make up most postings.
HOT, HOT_SHARE = 512, 1 / 32


class _Index:
    """An inverted index of documents: postings of BM25 weights by word; the most frequent words as rows of a matrix."""

    def __init__(self, n: int, doc: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.n = n
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, term = doc[order], weight[order].astype(np.float32), term[order]
        found, first, many = np.unique(term, return_index=True, return_counts=True)
        often = np.argsort(-many, kind="stable")[:HOT]
        often = often[many[often] > max(self.n * HOT_SHARE, 32)]
        # a word of one document only has no neighbours
        some = many > 1
        self.where = dict(zip(found[some].tolist(), zip(first[some].tolist(), (first + many)[some].tolist())))
        self.hot = {t: k for k, t in enumerate(found[often].tolist())}
        self.dense = np.zeros((len(self.hot), self.n), np.float32)
        for t, k in self.hot.items():
            a, b = self.where.pop(t)
            self.dense[k, self.doc[a:b]] = self.weight[a:b]

    def scores(self, queries: list[bytes], n: int | None = None) -> np.ndarray:
        """The score of each of the first ``n`` documents (all, if None) for each query, a document's words."""
        n = self.n if n is None else n
        asked = [np.frombuffer(q, np.uint32).tolist() for q in queries]
        known = np.zeros((len(queries), len(self.hot)), np.float32)
        for i, q in enumerate(asked):
            known[i, [self.hot[t] for t in q if t in self.hot]] = 1
        out = known @ self.dense[:, :n]
        for i, q in enumerate(asked):
            if spans := [self.where[t] for t in q if t in self.where]:
                out[i] += np.bincount(np.concatenate([self.doc[a:b] for a, b in spans]), np.concatenate([self.weight[a:b] for a, b in spans]), self.n)[:n]
        return out


def _choose(size: np.ndarray, score: np.ndarray, room: int, slack: int) -> Iterator[int]:
    """Positions of what fills the room, best score first; a neighbour that closes it is preferred.

    ``size`` is in ascending order; what may not be taken has a score below zero. ``score`` is used up.
    """
    while fits := int(np.searchsorted(size, room, "right")):
        best, tight = int(np.argmax(score[:fits])), int(np.searchsorted(size, room - slack))
        if score[best] < 0:
            return
        if score[best] == 0:  # no neighbours: the largest that fits
            best = int(np.flatnonzero(score[:fits] == 0)[-1])
        elif tight < fits and score[closing := tight + int(np.argmax(score[tight:fits]))] > 0:
            best = closing
        yield best
        score[best] = -1
        room -= int(size[best])


def _fill(sizes: np.ndarray, capacity: int, terms: list[bytes], counts: list[bytes], weights: Weights, tolerance: float, block: int = 64) -> Iterator[list[int]]:
    """Containers as lists of positions: a seed and its retrieved neighbours. ``sizes`` is in ascending order.

    Scores of a block of seeds are found at once, as they do not depend on what is
    still free; the index is built anew when a quarter of its documents are used.
    """
    free, slack = np.ones(len(sizes), bool), int(tolerance * capacity)
    doc, term, weight = weights.of(terms, counts)
    at, index, seeds = np.arange(len(sizes)), None, len(sizes)
    while True:
        block_seeds = []
        while seeds and len(block_seeds) < block:
            seeds -= 1
            if free[seeds]:
                block_seeds.append(seeds)
        if not block_seeds:
            return
        if index is None or free[at].sum() < 0.75 * len(at):
            still = free[at]
            new, keep = np.cumsum(still, dtype=np.int32) - 1, still[doc]
            doc, term, weight, at = new[doc[keep]], term[keep], weight[keep], at[still]
            index, size = _Index(len(at), doc, term, weight), sizes[at]
        room = capacity - sizes[block_seeds]
        most = int(np.searchsorted(size, room.max(), "right"))
        scores = index.scores([terms[i] for i in block_seeds], most)
        scores[:, ~free[at[:most]]] = -1
        for i, seed in enumerate(block_seeds):
            if not free[seed]:
                continue
            taken = [int(np.searchsorted(at, seed))]
            scores[i:, [k for k in taken if k < most]] = -1
            if most and room[i] > 0:
                taken += _choose(size[:most], scores[i], int(room[i]), slack)
                scores[i:, [k for k in taken if k < most]] = -1
            members = at[taken].tolist()
            free[members] = False
            yield members


def _filled(weights, tolerance: float):
    """Fills containers from the documents of a shard."""

    def run(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["rest", "item"], ignore_index=True)
        sizes, capacity, items = held["rest"].to_numpy(np.int64), int(held["capacity"].iloc[0]), held["item"].to_numpy(np.int64)
        item, seed, full = [], [], []
        for members in _fill(sizes, capacity, held["terms"].tolist(), held["counts"].tolist(), weights.value, tolerance):
            item += items[members].tolist()
            seed += [items[members[0]]] * len(members)
            full += [bool(sizes[members].sum() >= (1 - tolerance) * capacity)] * len(members)
        return pd.DataFrame({"pack_id": held["pack_id"].iloc[0], "item": item, "seed": seed, "filled": full})

    return run


def _best_fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best fit, largest first, over a bounded number of released items; what has a unit in common stays together."""
    pdf = pdf.assign(total=pdf.groupby("unit")["tokens"].transform("sum")).sort_values(["total", "unit"], ascending=[False, True], ignore_index=True)
    capacity, bucket = int(pdf["capacity"].iloc[0]), int(pdf["bucket"].iloc[0])
    room: list[tuple[int, int]] = []
    names, count = [], 0
    last = None
    for size, unit in zip(pdf["total"].tolist(), pdf["unit"].tolist()):
        if unit == last:
            names.append(names[-1])
            continue
        last = unit
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, name = room.pop(at)
        else:
            left, name, count = capacity, count, count + 1
        insort(room, (left - size, name))
        names.append(f"r{bucket}.{name}")
    pdf["container"] = names
    return pdf[[c.split()[0] for c in _OUT.split(", ")]]


def _per_task(values: dict[int, int]):
    return F.create_map(*[F.lit(x).cast("bigint") for pair in values.items() for x in pair])[F.col("pack_id")]


def pack(docs: DataFrame, specs: DataFrame, shard_docs: int = 65_536, shard_bytes: int = 1 << 27, tolerance: float = 0.03, released: int = 20_000) -> DataFrame:
    """One row per document or piece: pack_id, container, doc_id, piece, n_pieces, start, tokens, capacity.

    ``specs`` is a table of a few tasks (pack_id, source, capacity); it is read
    to the driver and refused beyond 1,000 rows. One task works on ``shard_docs``
    documents or ``shard_bytes`` bytes, a bucket of the last step on about
    ``released`` items.
    """
    spark = docs.sparkSession
    tasks = [(r.pack_id, r.key, r.capacity) for r in specs.select("pack_id", source_key().alias("key"), "capacity").limit(1001).collect()]
    if len(tasks) > 1000 or any(not c or c < 1 for _, _, c in tasks):
        raise ValueError("at most 1,000 packing tasks, each of a positive capacity")
    columns = [c.split()[0] for c in _OUT.split(", ")]
    exact = [F.col(c).cast("bigint") if c == "doc_id" else F.col(c) for c in columns]
    known = described(docs)
    weights = spark.sparkContext.broadcast(corpus_statistics(known))
    wanted = "array<struct<pack_id:bigint,key:string,capacity:bigint>>"
    listed = F.array(*[F.struct(F.lit(p).cast("bigint").alias("pack_id"), F.lit(k).cast("string").alias("key"), F.lit(c).cast("bigint").alias("capacity")) for p, k, c in tasks]).cast(wanted)

    def per_task(df: DataFrame) -> DataFrame:
        """A row per document and task, with the number of its pieces and the size of what is packed."""
        some = df.withColumn("task", F.explode(F.filter(listed, lambda t: t["key"].isNull() | (t["key"] == F.col("key"))))).drop("key").withColumns({"pack_id": F.col("task.pack_id"), "capacity": F.col("task.capacity")}).drop("task")
        pieces = F.ceil(F.col("size") / F.col("capacity")).cast("int")
        return some.withColumn("n_pieces", pieces).withColumn("rest", F.when(F.col("size") > F.col("capacity"), F.col("size") % F.col("capacity")).otherwise(F.col("size")))

    items = per_task(known.select("item", "doc_id", "key", "size"))
    # only documents larger than the container are cut; a multiple of the capacity leaves no rest
    whole = F.floor(F.col("size") / F.col("capacity")).cast("bigint")
    cuts = items.where("size > capacity").select("*", F.posexplode(F.sequence(F.lit(1).cast("bigint"), whole)).alias("piece", "nth"))
    cuts = cuts.select("pack_id", F.concat_ws(".", "item", "piece").alias("container"), "doc_id", "piece", "n_pieces", (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("tokens"), "capacity")
    placed, where = sharded(known, items.where("rest > 0"), weights, shard_docs, shard_bytes)
    open_ = per_task(placed.drop("doc_id")).where("rest > 0")
    shard = F.lit(0)
    if where is not None:
        open_ = open_.join(F.broadcast(where), ["pack_id", "cell"], "left")  # a row per task and cell: at most 1,000 times MAX_CELLS
        shard = F.coalesce(F.col("first") + F.pmod(F.xxhash64("item"), F.col("shards")), F.lit(0))
    near = open_.select("pack_id", "capacity", "item", "rest", "terms", "counts", shard.cast("int").alias("shard"))
    members = near.groupBy("pack_id", "shard").applyInPandas(_filled(weights, tolerance), "pack_id bigint, item bigint, seed bigint, filled boolean")
    last = (F.col("n_pieces") - 1).cast("int")
    packed = members.join(items.where("rest > 0"), ["pack_id", "item"])
    packed = cut(packed.select("pack_id", F.when(F.col("filled"), F.concat(F.lit("s"), F.col("seed"))).alias("container"), "doc_id", last.alias("piece"), "n_pieces", (last.cast("bigint") * F.col("capacity")).alias("start"), F.col("rest").alias("tokens"), "capacity", F.col("seed"), F.col("item")))
    loose = packed.where(F.col("container").isNull())
    left = {r.pack_id: max(1, -(-r.n // released)) for r in loose.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = packed.where(F.col("container").isNotNull()).select(*columns).unionByName(cuts)
    if not left:
        return kept.select(*exact)
    # of a container with space left only the smallest member goes its own way, the others stay together
    rank = F.row_number().over(Window.partitionBy("pack_id", "seed").orderBy("tokens", "item"))
    alone = (rank == 1) & (F.col("item") != F.col("seed"))
    loose = loose.withColumn("unit", F.when(alone, F.concat(F.lit("i"), F.col("item"))).otherwise(F.concat(F.lit("s"), F.col("seed"))))
    loose = loose.withColumn("bucket", F.pmod(F.xxhash64("unit"), _per_task(left)))
    return kept.unionByName(loose.groupBy("pack_id", "bucket").applyInPandas(_best_fit, _OUT)).select(*exact)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per task: containers, tokens, the least possible number of containers, and the share of all capacity that is used."""
    total = packed.groupBy("pack_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"), F.max("capacity").alias("capacity"))
    return total.select("pack_id", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4).alias("used_share"))
