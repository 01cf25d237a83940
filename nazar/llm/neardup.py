"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

Texts are sets of five-word shingles; two texts are linked if their sets' Jaccard similarity is
0.8 or more.  Exact copies become one node first.  A node's MinHash signature is cut into TREES
runs of DEPTH values, one path for each prefix trie.  The forest is searched from the leaves:
nodes that share a whole path are compared with a few fixed nodes of their leaf (stars, linear
in the leaf), and every candidate link is verified on the whole shingle sets.  Then the matched
prefixes are shortened by a value, the node that stands for a leaf meets the others under the
same shorter prefix, and so on while the recall asks for it: for each band of similarity, the
verified links say which share of such pairs meets in some trie at this depth.  The descent ends
where that share reaches the target in every band, or at the depth that reaches it for pairs at
the threshold (5 at 0.8), whatever the data.  What is then still apart under a prefix of the
last depth is compared block by block, so no pair between classes is skipped and no group is
held by one task.  Linked nodes form classes (connected components).  The links of a document
are counted in its class, where every node meets every other one, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nazar.llm import tables, tokens

SIZE = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 8
TARGET_RECALL = 0.9995
#: Bands of similarity, to the unit, in which the recall is measured.
BANDS = 20
#: MinHash values of a text; the tries take the first ones, estimates take all.
SIGNATURE = 256
#: Nodes of a prefix group that all others are compared with first.
HEADS = 3
#: Members of a prefix group compared in one block.
BLOCK = 1_024
#: Rows of one task of the block comparison.
TASK_ROWS = 20_000
#: Members, and shingle hashes, of a class compared in one block when its links are counted.
CLASS_BLOCK, CLASS_HASHES = 2_048, 1_000_000
#: Pairs of members in one task of that count.
TASK_PAIRS = 4_000_000
#: Shingles whose holders are counted at once.
COLUMNS = 2_048
#: Shingle hashes of one task of the exact check of blocks.
TASK_HASHES = 4_000_000
#: Standard deviations below the threshold at which a signature's estimate still goes on to the exact check.
SLACK = 4.5
SEED = 29


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = TARGET_RECALL) -> int:
    """The longest prefix with which a pair at the threshold meets in a trie with the recall."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold ** k) ** trees >= recall:
            return k
    return 1


def value_bits(floor: int) -> int:
    """Bits that a path keeps of each value below the first ``floor`` ones."""
    return min(16, 62 // max(1, DEPTH - floor))


def meeting_share(links: DataFrame, depth: int, trees: int = TREES) -> float | None:
    """The least, over bands of similarity, of the share of pairs like the links (column s, their
    similarity) that meet in a trie at the depth: found links over the number they stand for.
    None without links."""
    share = 1 - F.pow(1 - F.pow("s", F.lit(depth)), F.lit(trees))
    bands = links.groupBy(F.floor(F.col("s") * BANDS)).agg((F.count("*") / F.sum(1 / share)).alias("share"))
    return bands.agg(F.min("share")).first()[0]


def _hash_params(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = tokens.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(SEED) + np.uint64(SEED))
    return base[:n] | np.uint64(1), base[n:]


def signatures(h: np.ndarray, text: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(MinHash signatures: n x texts with shingles, which texts)."""
    own, first = np.unique(text, return_index=True)
    out = np.zeros((n, len(own)), dtype=np.uint32)
    mult, add = _hash_params(n)
    for j in range(n if len(own) else 0):
        out[j] = np.minimum.reduceat(((h * mult[j] + add[j]) >> np.uint64(32)).astype(np.uint32), first)
    return out, own


def _sign_batch(batch: pa.RecordBatch, at: int, floor: int) -> pa.RecordBatch:
    keys, rest, sigs, counts = [], [], [], []
    bits = value_bits(floor)
    for _, data, offsets in tokens.text_slices(batch.column(at)):
        rows = len(offsets) - 1
        h, text = tokens.shingles(*tokens.words(data, offsets)[:2], rows, SIZE)
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[fresh], text[fresh]
        sig, own = signatures(h, text, rows, max(SIGNATURE, TREES * DEPTH))
        counts.append(np.bincount(text, minlength=rows))
        key, deep = (np.zeros((TREES, len(own)), dtype=np.uint64) for _ in range(2))
        for j in range(TREES):
            for k in range(floor):
                key[j] = tokens.mix(key[j] * np.uint64(31) + sig[j * DEPTH + k] + np.uint64(j + 1))
            for k in range(floor, DEPTH):
                deep[j] = (deep[j] << np.uint64(bits)) | (sig[j * DEPTH + k] & np.uint64((1 << bits) - 1))
        has = np.zeros(rows, dtype=np.int64)
        has[own] = np.arange(1, len(own) + 1)
        flat, below, low = key.T.astype(np.int64), deep.T.astype(np.int64), (sig.T & 0xFFFF).astype("<u2")
        keys += [flat[i - 1] if i else None for i in has]
        rest += [below[i - 1] if i else None for i in has]
        sigs += [low[i - 1].tobytes() if i else None for i in has]
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    cols = [pa.array(keys, pa.list_(pa.int64())), pa.array(rest, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["keys", "deep", "sig", "n"])


def _signed(docs: DataFrame, floor: int) -> DataFrame:
    """doc_id, h (digest of the text), keys (the shortest prefix in each trie), deep (the path's
    further values, packed), sig, n (shingles)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _sign_batch(b, 2, floor)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *got.columns], names=["doc_id", "h", "keys", "deep", "sig", "n"])

    return tables.spread_out(src).mapInArrow(run, "doc_id long, h binary, keys array<long>, deep array<long>, sig binary, n long")


def _sets(texts: DataFrame) -> DataFrame:
    """nid, s: the distinct shingle hashes of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at = b.column(0), 0
            for _, data, offsets in tokens.text_slices(b.column(1)):
                rows = len(offsets) - 1
                h, text = tokens.shingles(*tokens.words(data, offsets)[:2], rows, SIZE)
                cut = np.searchsorted(text, np.arange(rows + 1))
                own = [np.unique(h[cut[r]:cut[r + 1]]).astype(np.int64) for r in range(rows)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, rows), pa.array(own, pa.list_(pa.int64()))], names=["nid", "s"])
                at += rows

    return texts.select("nid", "text").mapInArrow(run, "nid long, s array<long>")


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """nid, s for the nodes of ``wanted`` (nid): only their texts are read again."""
    wanted = wanted.distinct().join(nodes.select("nid", "h", "doc_id"), "nid")
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.unhex(F.md5("text")).alias("g"), "text")
    texts = texts.join(wanted, (F.col("g") == F.col("h")) & F.col("d").eqNullSafe(F.col("doc_id")))
    return tables.save(tables.save(_sets(texts)).dropDuplicates(["nid"]))  # equal rows of documents


def _similar_size(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    size = nodes.select("nid", "n")
    near = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    return tables.save(near.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb")))


def _verified(near: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, s (similarity): the pairs of nodes whose whole shingle sets are similar enough."""
    both = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    both = both.select("a", "b", (F.col("na") + F.col("nb")).alias("all"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    linked = both.where(F.col("shared") >= threshold * (F.col("all") - F.col("shared")))
    return tables.save(linked.select("a", "b", (F.col("shared") / (F.col("all") - F.col("shared"))).alias("s")))


def contracted(links: DataFrame) -> DataFrame:
    """a, b: as few links as nodes, and some between heads, that connect the same nodes as the
    links (a node, a head).  A node keeps the link to its smallest head; the others, of which it
    has a bounded number, are links of that head with them, the same for many nodes."""
    heads = links.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("heads"))
    first = heads.select("a", F.element_at("heads", 1).alias("b"))
    further = heads.select(F.element_at("heads", 1).alias("a"), F.explode(F.expr("slice(heads, 2, size(heads))")).alias("b"))
    return first.unionByName(further.distinct())


def forest_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, floor: int) -> tuple[DataFrame, int]:
    """(verified links a, b, s of nodes with heads; the depth at which the descent ended) for
    ``members`` (nid, tree, key, deep): the nodes with company under their shortest prefix."""
    level, bits, target = DEPTH, value_bits(floor), TARGET_RECALL
    heads = F.array_distinct(F.array(*[F.min_by("nid", F.xxhash64(F.lit(r), "nid")) for r in range(HEADS)]))
    alive = members.withColumnRenamed("deep", "p")
    links = compared = None
    while True:
        leaves = tables.save(alive.groupBy("tree", "key", "p").agg(heads.alias("heads"), F.count("*").alias("size")))
        star = alive.join(leaves.where("size > 1").drop("size"), ["tree", "key", "p"])
        star = star.select(F.col("nid").alias("a"), F.explode("heads").alias("b")).where("a != b").distinct()
        if compared is not None:
            star = star.join(compared, ["a", "b"], "left_anti")
        star = tables.save(star)
        compared = star if compared is None else compared.unionByName(star)
        found = _verified(_similar_size(star, nodes, threshold), sets, threshold)
        links = found if links is None else links.unionByName(found)
        share = meeting_share(links, level)
        if level == floor or share is not None and share >= target:
            return links, level
        level -= 1
        alive = leaves.select("tree", "key", F.shiftright("p", bits).alias("p"), F.element_at("heads", 1).alias("nid"))


def components(edges: DataFrame) -> DataFrame:
    """nid, label: the smallest node connected with each node of an edge.  Labels take the
    smallest neighbouring label, then the label of their label, until none changes."""
    both = tables.save(edges.union(edges.select("b", "a")).distinct())
    labels = tables.save(both.groupBy(F.col("a").alias("nid")).agg(F.least(F.min("b"), F.col("nid")).alias("label")))
    while True:
        heard = both.join(labels, both["b"] == labels["nid"]).groupBy(F.col("a").alias("nid")).agg(F.min("label").alias("other"))
        step = labels.join(heard, "nid").select("nid", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        step = tables.save(step)
        via = step.select(F.col("nid").alias("label"), F.col("label").alias("further"))
        jumped = step.join(via, "label", "left").select("nid", "old", F.coalesce("further", "label").alias("label"))
        jumped = tables.save(jumped)
        labels = jumped.select("nid", "label")
        if jumped.where("old != label").isEmpty():
            return labels


def _spanning(pairs: list[tuple[int, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """(label, label) rows, fewer than labels, that connect what the pairs (label, labels) connect."""
    root = np.arange(len(labels))
    for one, others in pairs:
        met = np.unique(root[np.searchsorted(labels, np.append(others, one))])
        if len(met) > 1:
            root[np.isin(root, met)] = met[0]
    own = np.flatnonzero(root != np.arange(len(labels)))
    return np.column_stack([labels[own], labels[root[own]]])


def _apart(members: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of classes, by their labels, that still lie apart though nodes of them under
    the same prefix are similar.  Members outside the group's main class meet all members, block
    by block: signatures first, then the whole shingle sets of the nodes that still have a
    partner, in the same blocks.  A pair is compared in the first trie where it meets.  Rows move
    for each node, never for each pair, and a block gives fewer links than it has classes."""
    m = members.join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    per = m.groupBy("tree", "key").agg(F.min_by("label", "nid").alias("main"), F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    per = per.where("lo != hi and size > 2").drop("lo", "hi")
    m = m.join(per, ["tree", "key"])
    per_minor = m.where("label != main").groupBy("tree", "key").agg(F.count("*").alias("minors"))
    m = m.join(per_minor, ["tree", "key"])
    n_all = F.ceil(F.col("size") / BLOCK).cast("int")
    n_minor = F.ceil(F.col("minors") / BLOCK).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    block = ["tree", "key", "i", "j"]
    minor = (F.col("label") != F.col("main")).alias("minor")
    everyone = m.select("tree", "key", "nid", "label", minor, F.lit(0).alias("role"), F.pmod(F.xxhash64("nid"), n_all).cast("int").alias("i"), upto(n_minor).alias("j"))
    minors = m.where("label != main").select("tree", "key", "nid", "label", minor, F.lit(1).alias("role"), upto(n_all).alias("i"), F.pmod(F.xxhash64(F.lit(1), "nid"), n_minor).cast("int").alias("j"))
    rows = tables.save(everyone.unionByName(minors))
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    rows = rows.join(nodes.select("nid", "sig", "n", "keys"), "nid")
    least = max(0.0, threshold - SLACK * (threshold * (1 - threshold) / max(SIGNATURE, TREES * DEPTH)) ** 0.5)

    def blocks(pdf: pd.DataFrame) -> Iterator[tuple[int, int]]:
        group = pdf[block].to_numpy()
        cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1), True])
        return zip(cut[:-1], cut[1:], strict=True)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*block, "role", "nid"], kind="stable").reset_index(drop=True)
        nid, label, role, n, tree, minor = (pdf[c].to_numpy() for c in ("nid", "label", "role", "n", "tree", "minor"))
        sig = np.frombuffer(b"".join(pdf["sig"]), "<u2").reshape(len(pdf), -1)
        keys = np.stack(pdf["keys"].to_numpy())
        out: list[tuple] = []
        for lo, hi in blocks(pdf):
            mid = lo + int(np.searchsorted(role[lo:hi], 1))
            partners: dict[int, list[int] | None] = {}
            size: dict[int, int] = {}
            named: dict[int, int] = {}
            for k in range(mid, hi):
                ok = (label[lo:mid] != label[k]) & (np.minimum(n[lo:mid], n[k]) >= threshold * np.maximum(n[lo:mid], n[k]))
                ok &= ~minor[lo:mid] | (nid[lo:mid] > nid[k])
                ok = np.flatnonzero(ok) + lo
                ok = ok[~(keys[ok, :tree[k]] == keys[k, :tree[k]]).any(axis=1)]
                ok = ok[(sig[ok] == sig[k]).mean(axis=1) >= least]
                if len(ok):
                    partners[nid[k]] = nid[ok].tolist()
                    size[nid[k]], named[nid[k]] = n[k], label[k]
                    for o in ok:
                        partners.setdefault(nid[o], None)
                        size[nid[o]], named[nid[o]] = n[o], label[o]
            at = tuple(pdf[c].iloc[lo] for c in block)
            out += [(*at, x, named[x], size[x], with_) for x, with_ in partners.items()]
        return pd.DataFrame(out, columns=[*block, "nid", "label", "n", "partners"])

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(block, kind="stable").reset_index(drop=True)
        found: list[np.ndarray] = []
        for lo, hi in blocks(pdf):
            ids = pdf["nid"].iloc[lo:hi]
            own, named = dict(zip(ids, pdf["s"].iloc[lo:hi], strict=True)), dict(zip(ids, pdf["label"].iloc[lo:hi], strict=True))
            pairs: list[tuple[int, np.ndarray]] = []
            for x, with_ in zip(ids, pdf["partners"].iloc[lo:hi], strict=True):
                if with_ is None:
                    continue
                mine = np.sort(own[x])
                for some in np.array_split(np.asarray(with_, dtype=np.int64), -(-len(with_) // 64)):
                    theirs = [own[o] for o in some]
                    lengths = np.array([len(t) for t in theirs])
                    flat = np.concatenate(theirs)
                    hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                    shared = np.add.reduceat(hit, np.cumsum(lengths) - lengths, dtype=np.int64)
                    linked = some[shared >= threshold * (len(mine) + lengths - shared)]
                    if len(linked):
                        pairs.append((named[x], np.unique([named[o] for o in linked])))
            if pairs:
                found.append(_spanning(pairs, np.unique(list(named.values()))))
        pairs_found = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs_found[:, 0], "b": pairs_found[:, 1]})

    def task(n: int):
        return F.pmod(F.xxhash64(*block), F.lit(n)).alias("task")

    likely = rows.groupBy(task(tasks)).applyInPandas(compare, "tree int, key long, i int, j int, nid long, label long, n long, partners array<long>")
    likely = tables.save(likely)
    hashes = likely.agg(F.sum("n")).first()[0] or 0
    likely = likely.join(sets, "nid")
    return likely.groupBy(task(max(1, -(-hashes // TASK_HASHES)))).applyInPandas(verify, "a long, b long")


def shared_counts(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of each set of ``one`` with each set of ``other`` (distinct values each)."""
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, other)]
    held = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (one, other)]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]))
    out = np.zeros((len(one), len(other)), dtype=np.float32)  # exact below 2 ** 24
    if not len(both):
        return out
    cells = []
    for values, rows in zip(flat, held, strict=True):
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        hit = both[at] == values
        order = np.argsort(at[hit], kind="stable")
        cells.append((at[hit][order], rows[hit][order]))
    for lo in range(0, len(both), COLUMNS):
        grids = []
        for (at, rows), n in zip(cells, out.shape, strict=True):
            x, y = np.searchsorted(at, [lo, lo + COLUMNS])
            grid = np.zeros((n, COLUMNS), dtype=np.float32)
            grid[rows[x:y], at[x:y] - lo] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


def linked_documents(labels: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """nid, links: the documents of other nodes that each node of a class is linked with.  All
    nodes of a class meet, block by block; rows move and come out for each node of a block."""
    own = labels.join(nodes.select("nid", "n", "copies"), "nid")
    per = own.groupBy("label").agg(F.count("*").alias("size"), F.sum("copies").alias("docs"), F.sum("n").alias("hashes"))
    own = tables.save(own.join(per, "label"))
    pairs = per.where("size > 2").agg(F.sum(F.col("size") * F.col("size") / 2)).first()[0] or 0
    # the two nodes of a class of two are linked
    two = own.where("size = 2").select("nid", (F.col("docs") - F.col("copies")).alias("links"))
    of = F.greatest(F.ceil(F.col("size") / CLASS_BLOCK), F.ceil(F.col("hashes") / CLASS_HASHES)).cast("int")
    many = own.where("size > 2").withColumn("of", of).withColumn("at", F.pmod(F.xxhash64("nid"), "of").cast("int"))
    rows = many.select("label", "nid", "n", "copies", "at", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("with"))
    rows = rows.select("label", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), "at", "nid", "n", "copies")
    rows = tables.save(rows)
    hashes = rows.agg(F.sum("n")).first()[0] or 0
    block = ["label", "i", "j"]

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*block, "at", "nid"], kind="stable").reset_index(drop=True)
        group = pdf[block].to_numpy()
        cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1), True])
        n, copies, at, s = (pdf[c].to_numpy() for c in ("n", "copies", "at", "s"))
        links = np.zeros(len(pdf), dtype=np.int64)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            i, j = group[lo, 1:]
            mid = lo + int(np.searchsorted(at[lo:hi], j)) if i != j else hi
            other = slice(mid, hi) if i != j else slice(lo, hi)
            shared = shared_counts(list(s[lo:mid]), list(s[other])).astype(np.int64)
            linked = shared >= threshold * (n[lo:mid, None] + n[None, other] - shared)
            if i == j:
                np.fill_diagonal(linked, False)
            links[lo:mid] += linked @ copies[other]
            if i != j:
                links[mid:hi] += copies[lo:mid] @ linked
        return pd.DataFrame({"nid": pdf["nid"], "links": links})

    n_tasks = max(1, -(-hashes // TASK_HASHES), -int(-pairs // TASK_PAIRS))
    task = F.pmod(F.xxhash64(*block), F.lit(n_tasks)).alias("task")
    counted = rows.join(sets, "nid").groupBy(task).applyInPandas(count, "nid long, links long")
    return two.unionByName(counted.groupBy("nid").agg(F.sum("links").alias("links")))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The signed documents, the nodes (distinct texts: nid, h, smallest doc_id, copies, n), the
    labels (nid, label) of the linked ones, and their shingle sets."""
    spark = docs.sparkSession
    tables.small_batches(spark)
    floor = prefix_length(threshold)
    signed = tables.save(_signed(docs, floor))
    first = signed.where("h is not null").groupBy("h").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("keys", "deep", "sig", "n")])
    nodes = tables.save(first.withColumn("nid", F.monotonically_increasing_id()))
    path = nodes.where("n > 0").select("nid", F.posexplode(F.arrays_zip("keys", "deep")).alias("tree", "x")).select("nid", "tree", F.col("x.keys").alias("key"), "x.deep")
    shared = path.groupBy("tree", "key").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    members = tables.save(path.join(shared, ["tree", "key"]))
    sets = _sets_of(members.select("nid"), nodes, docs)
    links, level = forest_links(members, nodes, sets, threshold, floor)
    labels = components(contracted(links))
    if level > floor:  # groups of the depth where the descent ended
        prefix = lambda key, deep: F.xxhash64(key, F.shiftright(deep, value_bits(floor) * (DEPTH - level)))
        members = members.withColumn("key", prefix(F.col("key"), F.col("deep")))
        nodes = tables.save(nodes.withColumn("keys", F.zip_with("keys", "deep", prefix)))
    rest = tables.save(_apart(members.drop("deep"), labels, nodes, sets, threshold).distinct())
    if not rest.isEmpty():
        joined = components(rest).toDF("label", "top")
        known = labels.unionByName(joined.select(F.col("label").alias("nid"), "label").join(labels.select("nid"), "nid", "left_anti"))
        labels = tables.save(known.join(joined, "label", "left").select("nid", F.coalesce("top", "label").alias("label")))
    return signed, nodes, labels, sets


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links: one row a document (columns doc_id and text are read).

    class_id is the smallest doc_id of the document's class (null if all of them are).
    n_links counts the other documents that the document is linked with: exact copies, and
    those whose shingle sets are similar enough, each copy of a text for itself.
    Null texts link with nothing; texts without words only with exact copies; texts of one to
    four words have one shingle.  Equal rows are copies of each other.  An empty table gives
    an empty result.
    """
    signed, nodes, labels, sets = classes(docs, threshold)
    degree = linked_documents(labels, nodes, sets, threshold)
    named = nodes.join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    class_id = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = named.join(degree, "nid", "left").join(class_id, "label")
    named = named.select(F.col("h").alias("g"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "h").join(named, F.col("h") == F.col("g"), "left")
    return out.select("doc_id", F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op5(spark, sf_dir: str) -> DataFrame:
    return join(tables.table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the smallest doc_id (of equal rows, one); rows
    with a null text stay.  Columns as they came."""
    _, nodes, labels, _ = classes(docs, threshold)
    named = nodes.join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    # of each class, not of each id: unrelated texts may share an id, or have none
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    keep = named.groupBy("label").agg(first.alias("x")).select(F.col("x.doc_id").alias("__d"), F.col("x.h").alias("__h"))
    own = docs.withColumn("__g", F.unhex(F.md5("text")))
    kept = own.join(keep, (F.col("__g") == F.col("__h")) & own["doc_id"].cast("long").eqNullSafe(F.col("__d")))
    kept = kept.dropDuplicates(["__g", "doc_id"])
    return kept.select(*[kept[c] for c in docs.columns]).union(docs.where("text is null"))
