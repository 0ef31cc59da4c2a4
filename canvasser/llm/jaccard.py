"""Chosen-path join: documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

Sets are embedded as ``COORDINATES`` min-hash values; a token is a coordinate with its value, and
two sets share a token with the probability of their similarity. A run splits all sets on
``CHILDREN`` tokens sampled per node, buckets above ``LIMIT`` are split again on tokens sampled
anew, and what is left after ``DEPTH`` splits is compared by brute force, a large bucket in cells
(``buckets.py``). Runs are repeated until a pair at the threshold is missed with a probability of
at most 1 - ``RECALL`` even if each split of the deepest path has to keep it.

Within a cell pairs whose sketches agree too little are passed over (the bound is four standard
deviations below the threshold); all others are verified on the exact sets. A pair that meets in
several buckets counts in the first one only. Equal sets are one class: links are counted by
class and weighed by its size, so copies are never expanded, and links are never written pair by
pair: a cell hands on counts and the roots of its components.

Defined results: words are A-Z folded, digits, letters and everything outside ASCII. A text of one
to four words is one shingle of all of them; null, empty and wordless texts have no set and no
link. A document with a null id is compared like others and never names a class with an id.
Documents that repeat an id count each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvasser.llm import buckets
from canvasser.llm.common import LAST, pieces, rank_id, saved
from canvasser.llm.components import components
from canvasser.llm.hashing import join_texts, mix, windows, words

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 64
CHILDREN = 2
LIMIT = 1024
DEPTH = 3
BLOCK = 512
RECALL = 0.9999


def runs(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs that find a pair at the threshold with the wanted probability on the deepest path."""
    kept = (1 - (1 - threshold) ** CHILDREN) ** DEPTH
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - kept)))


def shingle_sets(texts: list, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted within each, and the number of each text."""
    data, begins = join_texts(texts)
    starts, _, hashes = words(data)
    text = np.searchsorted(begins, starts, "right") - 1
    n = np.bincount(text, minlength=len(texts))
    full = windows(hashes, size)
    at = np.flatnonzero(text[: len(full)] == text[size - 1 :]) if len(full) else np.zeros(0, np.int64)
    values, owner = [full[at]], [text[at]]
    first = np.cumsum(n) - n
    for k in range(1, size):  # shorter texts: all their words
        short = np.flatnonzero(n == k)
        if len(short):
            values.append(windows(hashes, k)[first[short]])
            owner.append(short)
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(texts))


def set_ids(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit name of each set; 0 for the empty set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values, 11))))
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        names = mix(sums[ends] - sums[ends - counts], 12) | np.uint64(1)
    return np.where(counts > 0, names, np.uint64(0)).view(np.int64)


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Min-hash values (texts, coordinates); rows of empty sets are zero."""
    odd = mix(np.arange(COORDINATES, dtype=np.uint64), 13) | np.uint64(1)
    out = np.zeros((len(counts), COORDINATES), np.uint64)
    have = np.flatnonzero(counts)
    if len(have):
        begins = (np.cumsum(counts) - counts)[have]
        with np.errstate(over="ignore"):
            for k in range(COORDINATES):
                out[have, k] = np.minimum.reduceat(values * odd[k], begins)
    return out


def document_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, item, n_shingles, signature): id ranks null last, mark is a hash of the text, item names the set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in pieces(batch["body"]):
                part = batch.iloc[a:b]
                values, counts = shingle_sets(list(part["body"]))
                rows = signatures(values, counts)
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(), "mark": part["mark"].to_numpy(), "item": set_ids(values, counts),
                    "n_shingles": counts, "signature": [r.tobytes() for r in rows],
                })

    rows = docs.select(rank_id(doc_id).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("body"))
    return rows.mapInPandas(run, "id long, mark long, item long, n_shingles long, signature binary")


def split(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys of the children of each membership: tokens are sampled by the node, values come from the set."""
    out = np.empty((len(keys), CHILDREN), np.uint64)
    at = np.arange(len(keys))
    with np.errstate(over="ignore"):
        for k in range(CHILDREN):
            chosen = (mix(keys, 20 + k) % np.uint64(COORDINATES)).astype(np.int64)
            if k:  # another coordinate than the first child's
                chosen = np.where(chosen == first, (chosen + 1) % COORDINATES, chosen)
            first = chosen
            out[:, k] = mix(keys * np.uint64(0x9E3779B97F4A7C15) + chosen.astype(np.uint64) + rows[at, chosen], 30 + k)
    return out


def _children(members: DataFrame) -> DataFrame:
    """Memberships one level down, from (key, item, signature)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch["signature"]), np.uint64).reshape(-1, COORDINATES)
            keys = split(batch["key"].to_numpy(np.int64).view(np.uint64), rows)
            yield pd.DataFrame({"key": keys.view(np.int64).ravel(), "item": np.repeat(batch["item"].to_numpy(), CHILDREN)})

    return members.select("key", "item", "signature").mapInPandas(run, "key long, item long")


def leaves(classes: DataFrame, n_runs: int, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """Memberships (key, item, n) of all buckets to compare, from (item, signature)."""
    nodes = classes.withColumn("key", F.explode(F.sequence(F.lit(1), F.lit(n_runs)))).withColumn("key", F.col("key").cast("long"))
    done = []
    for level in range(depth):
        rows = saved(buckets.sized(_children(nodes)), "chosen-paths")
        if level + 1 == depth:
            done.append(rows)
            break
        done.append(rows.filter(F.col("n") <= limit))
        large = rows.filter(F.col("n") > limit)
        if large.isEmpty():
            break
        nodes = large.select("key", "item").join(classes, "item")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _sketch(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), COORDINATES)


def _alike(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    return (sketch[a] == sketch[b]).sum(1) >= least


def least_agreement(threshold: float) -> int:
    """Coordinates that agree in all but one of 30,000 pairs at the threshold."""
    return max(1, math.floor(COORDINATES * threshold - 4 * math.sqrt(COORDINATES * threshold * (1 - threshold))))


def _with_partner(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """Memberships whose sketch is close to that of another item of the bucket."""
    least = least_agreement(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(rows: pd.DataFrame) -> pd.DataFrame:
            sketch, kept = _sketch(rows["sketch"]), np.zeros(len(rows), bool)
            for a, b in buckets.pairs(rows):
                for x in range(0, len(a), 20_000):
                    hit = _alike(sketch, a[x : x + 20_000], b[x : x + 20_000], least)
                    kept[a[x : x + 20_000][hit]] = True
                    kept[b[x : x + 20_000][hit]] = True
            return rows.loc[kept, ["key", "item"]]

        return buckets.whole_cells(batches, work)

    rows = buckets.by_cell(buckets.cells(members, block).select("key", "i", "j", "chunk", "item", "sketch"))
    return rows.mapInPandas(run, "key long, item long").distinct()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[code]
    owner, code = owner[use], number[code[use]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for begin in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(code, (begin, begin + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], code[a:b] - begin] = 1
        out += part @ part.T
    return out


def _link_cell(cell: pd.DataFrame, sets: list[np.ndarray], threshold: float, least: int) -> pd.DataFrame:
    """(item, links, root) of the items of one cell that have a verified link."""
    n, key = len(cell), int(cell["key"].iloc[0])
    sketch = _sketch(cell["sketch"])
    near = np.zeros((n, n), bool)
    for a in range(0, n, 64):
        near[a : a + 64] = (sketch[a : a + 64, None, :] == sketch[None]).sum(2) >= least
    near &= np.arange(n)[:, None] < np.arange(n)[None]
    if cell["i"].iloc[0] != cell["j"].iloc[0]:
        near &= cell["chunk"].to_numpy()[:, None] != cell["chunk"].to_numpy()[None]
    a, b = np.nonzero(near)
    size = np.array([len(s) for s in sets])
    if n > 16:
        both = _common(sets)[a, b]
    else:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
    linked = both >= threshold * (size[a] + size[b] - both) - 1e-9
    a, b = a[linked], b[linked]
    earlier = [sorted(k for k in keys if k < key) for keys in cell["keys"]]
    names = {k: i for i, k in enumerate(sorted({k for keys in earlier for k in keys}))}
    seen = np.zeros(len(a), bool)
    if names and len(a):
        inside = np.zeros((n, len(names)), np.float32)
        for i, keys in enumerate(earlier):
            inside[i, [names[k] for k in keys]] = 1
        seen = (inside @ inside.T)[a, b] > 0
    weight = cell["weight"].to_numpy()
    links = np.bincount(a[~seen], weights=weight[b[~seen]], minlength=n) + np.bincount(b[~seen], weights=weight[a[~seen]], minlength=n)
    item = cell["item"].to_numpy()
    root = buckets.roots(n, a, b)
    touched = np.unique(np.concatenate((a, b)))
    return pd.DataFrame({"item": item[touched], "links": links[touched].astype(np.int64), "root": item[root[touched]]})


def _verify(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(item, links, root) from (key, item, n, weight, sketch, keys, body)."""
    least = least_agreement(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            bounds = np.flatnonzero(np.diff(np.concatenate(([-1], buckets.cell_numbers(rows), [-1]))))
            begin = 0
            while begin < len(bounds) - 1:  # some cells at a time, to bound the words held
                end = begin + 1
                while end < len(bounds) - 1 and bounds[end + 1] - bounds[begin] <= 1000:
                    end += 1
                part = rows.iloc[bounds[begin] : bounds[end]].reset_index(drop=True)
                distinct, index = np.unique(part["item"], return_inverse=True)
                texts = part["body"].to_numpy()[np.unique(part["item"], return_index=True)[1]]
                sets = []
                for a, b in pieces(pd.Series(texts)):
                    values, counts = shingle_sets(list(texts[a:b]))
                    sets += np.split(values, np.cumsum(counts)[:-1])
                for c in range(begin, end):
                    a, b = bounds[c] - bounds[begin], bounds[c + 1] - bounds[begin]
                    out.append(_link_cell(part.iloc[a:b], [sets[k] for k in index[a:b]], threshold, least))
                begin = end
            return pd.concat(out)

        return buckets.whole_cells(batches, work)

    columns = ["key", "i", "j", "chunk", "item", "weight", "sketch", "keys", "body"]
    rows = buckets.by_cell(buckets.cells(members, block).select(*columns))
    return rows.mapInPandas(run, "item long, links long, root long")


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, limit: int = LIMIT, block: int = BLOCK, depth: int = DEPTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, mark, n_shingles, group, class (smallest id of the group) and n_links."""
    sets = saved(document_sets(docs, doc_id, text), "sets")
    class_of = sets.filter("item <> 0").groupBy("item").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.min("signature").alias("signature"))
    classes = saved(class_of.withColumn("sketch", _low_bytes("signature")), "classes")
    found = leaves(classes.select("item", "signature"), runs(threshold, recall), limit, depth)
    near = saved(_with_partner(found.join(classes.select("item", "sketch"), "item"), threshold, block), "near")
    near = saved(buckets.distinct_buckets(near), "buckets")
    keys = near.groupBy("item").agg(F.collect_list("key").alias("keys"))  # a few per split and run
    bodies = docs.select(rank_id(doc_id).alias("id"), F.col(text).alias("body"))
    wanted = classes.drop("signature").join(keys, "item").join(bodies, "id").filter("body IS NOT NULL")
    wanted = _of_item(wanted).dropDuplicates(["item"]).drop("id")
    links = saved(_verify(near.join(wanted, "item"), threshold, block), "links")
    counted = links.groupBy("item").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("item").alias("a"), F.col("root").alias("b")))
    named = classes.select("item", "id", "weight").join(counted, "item", "left").join(groups, F.col("item") == F.col("node"), "left")
    named = named.select("item", "id", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "item").alias("root"))
    first = named.groupBy("root").agg(F.min("id").alias("class"))
    named = named.join(first, "root").select("item", F.col("root").alias("group"), "class", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    out = sets.drop("signature").join(named, "item", "left")
    return out.select("id", "mark", "n_shingles", "group", F.coalesce("class", "id").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _low_bytes(signature: str):
    @F.pandas_udf("binary")
    def low(column: pd.Series) -> pd.Series:
        rows = np.frombuffer(b"".join(column), np.uint64).reshape(-1, COORDINATES)
        return pd.Series([r.tobytes() for r in (mix(rows, 40) & np.uint64(255)).astype(np.uint8)], dtype=object)

    return low(signature)


def _of_item(rows: DataFrame) -> DataFrame:
    """Rows whose body has the set of the item (an id may come with several texts)."""

    @F.pandas_udf("long")
    def name(bodies: pd.Series) -> pd.Series:
        parts = [set_ids(*shingle_sets(list(bodies[a:b]))) for a, b in pieces(bodies)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return rows.withColumn("own", name("body")).filter("own = item").drop("own")


def _id(column: str):
    return F.when(F.col(column) != LAST, F.col(column))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id, n_links (other documents at the threshold or above)."""
    return join(docs, **options).select(_id("id").alias("doc_id"), "n_shingles", _id("class").alias("class_id"), "n_links")


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without those whose group has one with a smaller id; one row of each group stays.

    Of rows that repeat an id within a group the one with the smallest text hash stays; rows equal
    in id and text stay once. Documents without a set all stay.
    """
    found = saved(join(docs, doc_id=doc_id, text=text, **options), "classes-of")
    with_set = found.filter("n_shingles > 0")
    place = F.row_number().over(Window.partitionBy("group").orderBy("id", "mark"))
    kept = with_set.filter("id = class").withColumn("place", place).filter("place = 1").select("id", "mark")
    gone = saved(with_set.join(kept, ["id", "mark"], "left_anti").select("id", "mark").distinct(), "gone")
    own_id, own_mark = "_" + doc_id + "_rank", "_" + doc_id + "_mark"
    rows = docs.withColumns({own_id: rank_id(doc_id), own_mark: F.xxhash64(text)})
    rest = rows.join(gone, (rows[own_id] == gone["id"]) & (rows[own_mark] == gone["mark"]), "left_anti")
    repeated = with_set.join(kept, ["id", "mark"]).groupBy("id", "mark").count().filter("count > 1").select("id", "mark")
    if not repeated.isEmpty():
        repeated = saved(repeated, "repeated")
        same = (rest[own_id] == repeated["id"]) & (rest[own_mark] == repeated["mark"])
        once = rest.join(repeated, same, "left_semi").dropDuplicates([own_id, own_mark])
        rest = rest.join(repeated, same, "left_anti").unionByName(once)
    return rest.select(*docs.columns)
