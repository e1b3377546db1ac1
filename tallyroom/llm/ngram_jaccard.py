"""N-gram Jaccard join by multiple-global-order filtering."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm import blocks
from tallyroom.llm.common import Scratch, components, join_groups, mix, rows_by_id, shingle_keys

#: Documents that are compared in one group.
GROUP = 512
#: Document frequencies are counted by all bits of a shingle's key but the last so many: sorted, the rest takes half the room. Where keys
#: share it, their frequencies are added: any order that all documents agree on will do, and no shared token seems to be one document's.
COUNT_SHIFT = 20


def prefix_length(n: int, threshold: Fraction) -> int:
    """Of n tokens in any global order, the first so many hold one that a set of at least this similarity has in its own."""
    return n - -(-n * threshold.numerator // threshold.denominator) + 1 if n else 0


def _sets(words: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    return [shingle_keys(words[a:b], size) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def _counted(keys: np.ndarray, shift: int) -> np.ndarray:
    return keys >> np.uint64(shift) << np.uint64(shift)


def _ask(size: int, buckets: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, doc_ids, sizes, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, starts, hashes = blocks.unpack(doc_ids, sizes, words)
                keys, counts = np.unique(_counted(np.concatenate(_sets(hashes, starts, size)), shift), return_counts=True)
                yield blocks.ask(keys, counts, block, buckets)

    return run


DOCUMENTS = "doc_id long, n long, sig0 long, sig1 long, prefix array<long>, ranks array<int>, keys binary"


def _prefixes(size: int, threshold: Fraction, shift: int):
    """Per document: the size of its set, a 128-bit signature of it, and, in order of rising document frequency, those of its
    prefix tokens that another document has, with their ranks in the set; the set itself if there are any."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = {name: block[name][0].as_py() for name in block.column_names}
        doc_ids, starts, words = blocks.unpack(row["doc_ids"], row["sizes"], row["words"])
        sets = _sets(words, starts, size)
        sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        keys, place = np.unique(_counted(every, shift), return_inverse=True)
        frequency = blocks.answer(answers, len(keys))[place]
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.lexsort((every, frequency, owner))
        rank = np.arange(len(every)) - np.repeat(ends - sizes, sizes)
        limit = np.array([prefix_length(int(n), threshold) for n in sizes])
        chosen = (rank < limit[owner]) & (frequency[order] > 1)
        used = order[chosen]
        prefix_ends = np.searchsorted(owner[used], np.arange(len(sets) + 1))
        has = np.diff(prefix_ends) > 0
        with np.errstate(over="ignore"):
            padded = np.append(every, np.uint64(0))
            at = np.minimum(ends - sizes, len(every))
            sig = [np.where(sizes > 0, np.add.reduceat(np.append(f(every), np.uint64(0)), at), np.uint64(0)) for f in (mix, lambda x: mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
        del padded
        lists = [pa.ListArray.from_arrays(pa.array(prefix_ends.astype(np.int32)), pa.array(x)) for x in (every[used].view(np.int64), rank[np.flatnonzero(chosen)].astype(np.int32))]
        return pa.table(
            {
                "doc_id": pa.array(doc_ids, mask=doc_ids == blocks.NULL_ID),
                "n": pa.array(sizes),
                "sig0": pa.array(sig[0].view(np.int64)),
                "sig1": pa.array(sig[1].view(np.int64)),
                "prefix": lists[0],
                "ranks": lists[1],
                "keys": pa.array([s.tobytes() if h else None for s, h in zip(sets, has.tolist(), strict=True)], pa.binary()),
            }
        )

    return run


# --- comparing the documents of a group ------------------------------------------------------------------------


def _shared(tokens: list[np.ndarray]) -> np.ndarray:
    """Which pairs of documents have a token in common: products of incidence matrices, over the tokens that several have."""
    n = len(tokens)
    sizes = [len(t) for t in tokens]
    every, owner = np.concatenate(tokens), np.repeat(np.arange(n), sizes)
    _, place, counts = np.unique(every, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    keep = counts[place] > 1
    column, owner = number[place[keep]], owner[keep]
    out = np.zeros((n, n), bool)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        has = np.zeros((n, min(4096, int(column[-1]) + 1 - first)), np.float32)
        has[owner[a:b], column[a:b] - first] = 1
        out |= has @ has.T > 0
    return out


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)


def links(sets: list[np.ndarray], rare: list[np.ndarray], threshold: Fraction, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of at least the threshold that connect whatever links connect: pairs already connected aren't compared.

    A pair is compared only if it shares prefix tokens under all three orders: rising document frequency (rare),
    rising and falling hash; and if its sizes allow the threshold. known: positions with equal values are connected.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    low, high = np.minimum.outer(size, size), np.maximum.outer(size, size)
    pairs = threshold.denominator * low >= threshold.numerator * high
    p = [prefix_length(int(k), threshold) for k in size]
    for tokens in (rare, [s[:k] for s, k in zip(sets, p, strict=True)], [s[len(s) - k :] for s, k in zip(sets, p, strict=True)]):
        pairs &= _shared(tokens)
    forest, out = Forest(n), []
    if known is not None:
        first: dict[int, int] = {}
        for i, k in enumerate(known):
            forest.join(i, first.setdefault(k, i))
    for i in range(n):
        others = [j for j in np.flatnonzero(pairs[i, :i]).tolist() if forest.find(j) != forest.find(i)]
        at, step = 0, 4
        while at < len(others):
            some = [j for j in others[at : at + step] if forest.find(j) != forest.find(i)]
            at, step = at + step, min(64, step * 2)
            if not some:
                continue
            every = np.concatenate([sets[j] for j in some])
            place = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
            ends = np.cumsum(size[some])
            common = np.diff(np.concatenate([[0], np.cumsum(sets[i][place] == every)[ends - 1]]))
            for j, c in zip(some, common.tolist(), strict=True):
                if threshold.denominator * c >= threshold.numerator * (int(size[i]) + int(size[j]) - c) and forest.find(i) != forest.find(j):
                    forest.join(i, j)
                    out.append((i, j))
    return out


def _compare(threshold: Fraction):
    def run(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
        rare = [np.array(x, np.int64).view(np.uint64) for x in table["prefix"].to_pylist()]
        found = links(sets, rare, threshold)
        return pa.table({"a": pa.array(ids[[i for i, _ in found]], pa.int64()), "b": pa.array(ids[[j for _, j in found]], pa.int64())})

    return run


def candidate_pairs(large: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (a, b) of documents of different labels that may link, one of each not in its family's main part.

    They share a prefix token in the order of rising document frequency, and neither the sizes nor the token's ranks rule the
    link out: with it as their first common token, they have no more in common than what is left of the shorter rest.
    """
    num, den = threshold.numerator, threshold.denominator
    tokens = F.explode(F.arrays_zip("prefix", "ranks")).alias("t")
    posting = large.select("doc_id", "n", "label", (F.col("label") == F.col("main")).alias("is_main"), tokens)
    side = lambda s: posting.select(F.col("t.prefix").alias("token"), F.col("t.ranks").alias(f"rank_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "label", "is_main")))
    pairs = side("a").where("not is_main_a").join(side("b"), "token").where("label_a <> label_b and (is_main_b or doc_id_a < doc_id_b)")
    most = 1 + F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b")) - 1
    sizes = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    pairs = pairs.where(sizes & (most * den >= (F.col("n_a") + F.col("n_b") - most) * num))
    return pairs.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()


def _verify(threshold: Fraction):
    """Of candidate pairs, those that share prefix tokens under the two hash orders as well and have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                p, q = prefix_length(len(s), threshold), prefix_length(len(t), threshold)
                if not (np.isin(s[:p], t[:q]).any() and np.isin(s[len(s) - p :], t[len(t) - q :]).any()):
                    keep.append(False)
                    continue
                common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                keep.append(threshold.denominator * common >= threshold.numerator * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return run


def groups(docs: DataFrame, words: int = 5, threshold: float | str | Fraction = "0.8", id_col: str = "doc_id", text_col: str = "text", block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, copies (rows with the same set that count as one class).

    Two documents link when the Jaccard similarity of their sets of word shingles is at least the threshold; a
    component is all that links reach, named by its smallest id. Words are what stands between white space after
    lower-casing A-Z. A text with fewer words than a shingle is one shingle; null texts and those without words have none
    and link with nothing. Rows with equal ids are one node. Rows without an id link with nothing and have a null
    component. Extra columns are not read. An empty table gives none.

    Steps, each a Spark job over all rows:
    1. Blocks of hashed words; document frequencies of all shingles by one exchange (blocks.py).
    2. Prefixes in the first global order, rising document frequency. Only tokens that several documents have are posted.
    3. Equal sets become one class. Each token ties its documents to the smallest of them: a star, not all pairs. The
       components of the stars hold every link.
    4. Inside them, groups of bounded size are compared: pairs must share prefix tokens under two further orders as well,
       then are verified exactly; pairs that are connected already are not. Larger components are cut into chunks: each is
       compared with itself and a hub. What isn't in the component's main part then is joined on prefix tokens with all of the
       component, and the candidates are verified likewise.
    """
    threshold = Fraction(str(threshold))
    scratch = Scratch(docs.sparkSession, "jaccard")
    with blocks.in_place(docs, id_col, text_col, block_bytes, "jaccard") as table:
        buckets = blocks.bucket_count(table.count())
        answers = scratch.keep(blocks.totals(table.mapInArrow(_ask(words, buckets, COUNT_SHIFT), blocks.ASK)), "answers")
        sets = scratch.keep(blocks.with_answers(table, answers, _prefixes(words, threshold, COUNT_SHIFT), DOCUMENTS), "sets")
        scratch.drop(answers)

    posted = sets.where(F.col("keys").isNotNull() & F.col("doc_id").isNotNull())
    same = ["sig0", "sig1", "n"]
    classes = posted.groupBy(same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    classes = scratch.keep(classes, "classes")
    members = join_groups(posted.select("doc_id", *same), classes, same, "copies", posted.count())
    members = scratch.keep(members.select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")), "members")
    reps = members.where("doc_id = rep").select("doc_id").distinct()
    of_class = posted.join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id", "sig0", "sig1"])

    posting = of_class.select("doc_id", F.explode("prefix").alias("token"))
    leads = posting.groupBy("token").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").select("token", "lead")
    stars = posting.join(leads, "token").where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct()
    families = components(stars, scratch).withColumnRenamed("component", "family")
    families = scratch.keep(families, "families")

    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("size")).select("family", F.ceil(F.col("size") / F.lit(GROUP)).cast("int").alias("chunks"))
    dealt = families.join(sizes, "family").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = of_class.select("doc_id", "n", "prefix", "ranks", "keys").join(dealt.withColumnRenamed("node", "doc_id"), "doc_id")
    rows = scratch.keep(rows, "rows")
    own = F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))  # chunk 0 is the hub
    first = rows.withColumn("group", F.explode(own)).select("family", "group", "doc_id", "keys", "prefix")
    found = scratch.keep(first.groupBy("family", "group").applyInArrow(_compare(threshold), "a long, b long"), "links")

    if not rows.where("chunks > 1").limit(1).isEmpty():
        label = components(found, scratch)
        large = rows.where("chunks > 1").join(label, F.col("doc_id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "doc_id")).drop("node", "component")
        counts = large.groupBy("family", "label").count()
        main = counts.groupBy("family").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        large = scratch.keep(large.join(main, "family"), "large")
        sets_of = lambda s: large.select(F.col("doc_id").alias(s), F.col("keys").alias(f"keys_{s}"))  # noqa: E731  of_class has each set of an id once
        pairs = scratch.keep(candidate_pairs(large, threshold), "pairs")
        both = pairs.join(sets_of("a"), "a").join(sets_of("b"), "b").select("a", "b", "keys_a", "keys_b")
        more = both.mapInArrow(_verify(threshold), "a long, b long")
        found = scratch.keep(found.union(more), "links")

    label = components(found, scratch)
    named = members.join(label, members.rep == label.node, "left").select("doc_id", F.coalesce("component", "rep").alias("component"), "copies")
    named = named.groupBy("doc_id").agg(F.min("component").alias("component"), F.max("copies").alias("copies"))
    out = sets.select("doc_id", "n").join(named, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies")
    )
    return scratch.finish(out, "groups")


def drop_near_copies(docs: DataFrame, words: int = 5, threshold: float | str | Fraction = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id names their component: one document of each group. Rows without an id stay."""
    gone = groups(docs, words, threshold, id_col, text_col).where("component_id <> doc_id").select("doc_id")
    return rows_by_id(docs, id_col, gone, "left_anti")
