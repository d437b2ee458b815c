"""Near-duplicate documents by a chosen-path set similarity join on minwise tokens.

A document is its set of five-word shingles; two are linked from a Jaccard similarity of
``THRESHOLD`` percent on. Documents of equal sets form a class, and all that follows is about
classes. A class has a sketch of ``PLACES`` minwise tokens.

``TREES`` trees over this one sketch each send every class to the node of two of its minwise tokens,
the first two steps of its path: classes of similarity J share it with probability J squared. Then

1. *Stars.* Every node proposes its smallest member to each other member; a class keeps the
   proposal that most trees agree on. Proposals are checked on full sets, and those that hold
   join classes into components. Copies and near copies of one text, however many, are joined
   by no more checks than there are classes.
2. *Paths.* Nodes whose members are in different components are searched. Up to ``SMALL``
   members are compared exhaustively. A larger node branches: it chooses ``BRANCHES`` further
   places of the sketch by its own hash, and members go to the child of each token they have
   there. After ``DEPTH`` levels a node that is still large is compared exhaustively in blocks
   of members, so nothing is left out. Members of one component are not compared again, and a
   pair that meets in small nodes of several trees is compared in the first of them.
3. Pairs whose sketches agree are checked on full sets, in the node, best first; a check is
   spared where earlier ones have connected its ends. The links that hold give the components.

Sketches of a pair on the threshold agree on 192 of 256 places on average, with a standard
deviation of 6.2 for sets of 1200 shingles and 7.9 for sets of 64 (5000 simulated pairs each);
pairs under ``LEAST_AGREE``, over five deviations below, are passed over. If places were
independent, no tree would name such a pair with a probability of 0.000002.

A set of fewer than ``EXACT`` shingles fills few places, the others repeat them, and one foreign
shingle can spoil many at once. Pairs with such a set do not depend on sketches: *prefixes* finds
all of them that the stars have not joined. Of two sets on the threshold each lacks a quarter of
its shingles at most, so they share one of the rarest quarter, and sets that do are counted out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqwatch.llm import fingerprints, kernels, tables

THRESHOLD = 75
PLACES = 256
TREES = 16
SMALL = 4096
BRANCHES = 3
DEPTH = 3
LEAST_AGREE = 150
LEAST_TREES = 4
EXACT = 64

ROWS = "doc_id long, key_ long, n_shingles long, set_a long, set_b long, sketch binary, roots array<long>"


def sets(docs: DataFrame) -> DataFrame:
    """Per row: the number of shingles, a 128-bit key of the set, the sketch and the trees' first nodes."""
    tries = fingerprints._tries(PLACES)
    places = np.arange(2 * TREES) * (PLACES // (2 * TREES))
    batch_of = kernels.record_batches([
        ("doc_id", pa.int64()), ("key_", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()),
        ("set_b", pa.int64()), ("sketch", pa.binary()), ("roots", pa.list_(pa.int64())),
    ])

    def row(hashes: np.ndarray) -> tuple:
        kept = fingerprints.densified(hashes, PLACES, tries)
        if kept is None:
            return 0, None, None, None, None
        tokens = kernels.mix(kept)
        keys = [int(kernels.mix(hashes ^ np.uint64(seed)).sum(dtype=np.uint64).view(np.int64)) for seed in (1, 2)]
        return len(hashes), *keys, tokens.astype(np.uint8).tobytes(), kernels.mix(tokens[places[::2]] * np.uint64(3) + tokens[places[1::2]]).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in kernels.blocks(batch):
                part = batch.slice(start, end - start)
                columns = zip(*(row(s) for s in kernels.shingle_sets(data, offsets)))
                yield batch_of(part.column("doc_id"), part.column("key_"), *columns)

    rows = docs.select(F.col("doc_id").cast("long"), "text", tables.text_key().alias("key_"))
    return tables.stored(rows.mapInArrow(run, ROWS), "shingle-sets")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rep, packed``: the deflated texts of the documents that stand for classes in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, _, _ in kernels.blocks(batch):
                part = batch.slice(start, end - start)
                small = [zlib.compress(t.encode(), 6) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("rep"), pa.array(small, pa.binary())], names=["rep", "packed"])

    rows = docs.select(F.col("doc_id").cast("long"), tables.text_key().alias("key_"), F.coalesce("text", F.lit("")).alias("text"))
    joined = rows.join(wanted.select("rep", "one.*"), ["doc_id", "key_"]).select("rep", "text")
    return tables.stored(joined.mapInArrow(run, "rep long, packed binary").dropDuplicates(["rep"]), "class-texts")


def _set(packed: bytes) -> np.ndarray:
    data = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    return next(kernels.shingle_sets(data, np.array([0, len(data)])))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets, as sorted distinct hashes, reach the threshold."""
    least, most = sorted((len(a), len(b)))
    if 100 * least < THRESHOLD * most:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= THRESHOLD * (len(a) + len(b) - common)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    first = texts.select(F.col("rep").alias("a"), F.col("packed").alias("text_a"))
    second = texts.select(F.col("rep").alias("b"), F.col("packed").alias("text_b"))
    joined = pairs.join(second, "b").join(first, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_id, kept = None, None  # pairs of one class mostly follow each other
        for batch in batches:
            out = []
            for a, b, text_a, text_b in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b"))):
                a, b = a.as_py(), b.as_py()
                if a != kept_id:
                    kept_id, kept = a, _set(text_a.as_py())
                if similar(kept, _set(text_b.as_py())):
                    out.append((a, b))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def components(links: DataFrame) -> DataFrame:
    """``rep, component`` for every class in a link: the smallest class reachable.

    Each round points every class to the smallest one among its own and its neighbours' roots,
    then halves the paths to the roots; a chain of n classes takes about log n rounds. Rounds
    end in stored tables. Neighbours are aggregated before they are shuffled, never listed.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = tables.stored(edges.filter("a <> b").distinct(), "edges")
    roots = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    roots = tables.stored(roots.withColumnRenamed("a", "rep"), "roots")
    while True:
        # Edges between roots: what is inside a component already drops out.
        a, b = roots.select(F.col("rep").alias("a"), F.col("root").alias("ra")), roots.select(F.col("rep").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(a, "a").join(b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = tables.stored(edges.distinct(), "edges")
        hop = roots.select(F.col("rep").alias("root"), F.col("root").alias("next"))
        best = edges.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("near"))
        step = roots.join(hop, "root").join(best, "root", "left")
        moved = step.select("rep", "root", F.least("next", F.coalesce("near", "next")).alias("to"))
        moved = tables.stored(moved, "roots")
        if not edges.take(1) and not moved.filter("root <> to").take(1):
            return moved.select("rep", F.col("to").alias("component"))
        roots = moved.select("rep", F.col("to").alias("root"))


def stars(members: DataFrame) -> DataFrame:
    """Proposals ``a, b``: for each class the smallest member of its nodes that most trees name."""
    centre = members.groupBy("node").agg(F.min("rep").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    named = members.join(centre, "node").filter("a <> rep").groupBy("rep", "a").agg(F.count("*").alias("trees"))
    best = Window.partitionBy("rep").orderBy(F.desc("trees"), "a")  # TREES rows at most
    chosen = named.filter(F.col("trees") >= LEAST_TREES).withColumn("at", F.row_number().over(best)).filter("at = 1")
    return chosen.select("a", F.col("rep").alias("b"))


NODE = ("node", "rep", "component", "side", "tree", "small", "sketch", "roots")


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The members of each node, from batches sorted by node; a node has ``2 * SMALL`` at most."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        edges = [0, *(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist(), len(nodes)]
        for start, end in zip(edges[:-1], edges[1:]):
            if start == end:
                continue
            if held and nodes[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = nodes[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def agreeing(node: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, places agreed) of the pairs of a node that are to be checked on full sets.

    They are in different components and on different sides (side -1: any), their sketches
    agree enough, and no earlier tree compares them in a small first node.
    """
    n = node.num_rows
    part, side = node.column("component").to_numpy(), node.column("side").to_numpy()
    sketch = np.frombuffer(b"".join(node.column("sketch").to_pylist()), dtype=np.uint8).reshape(n, PLACES)
    roots = node.column("roots").combine_chunks().flatten().to_numpy().reshape(n, TREES)
    small, tree = node.column("small").to_numpy(), int(node.column("tree")[0].as_py())
    before = (small[:, None] >> np.arange(TREES) & 1).astype(bool) & (np.arange(TREES) < tree)
    found = []
    for i in range(n - 1):
        rest = slice(i + 1, n)
        open_ = (part[rest] != part[i]) & ((side[rest] != side[i]) | (side[i] < 0))
        j = np.flatnonzero(open_)
        if len(j):
            agree = (sketch[rest][j] == sketch[i]).sum(axis=1)
            j, agree = j[agree >= LEAST_AGREE] + i + 1, agree[agree >= LEAST_AGREE]
            new = ~((roots[j] == roots[i]) & before[i]).any(axis=1)
            found.append((np.full(new.sum(), i), j[new], agree[new]))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of nodes that are in some pair to be checked."""
    for node in _nodes(batches):
        i, j, _ = agreeing(node)
        if len(i):
            for batch in node.take(pa.array(np.unique(np.concatenate([i, j])))).combine_chunks().to_batches():
                yield batch


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of nodes, checked on full sets, best pairs first, unless their ends are connected already."""
    for node in _nodes(batches):
        i, j, agree = agreeing(node)
        order = np.argsort(-agree, kind="stable")
        reps, packed = node.column("rep").to_numpy(), node.column("packed")
        names, group = np.unique(node.column("component").to_numpy(), return_inverse=True)
        parent, sets_, out = list(range(len(names))), {}, []
        for a, b in zip(i[order].tolist(), j[order].tolist()):
            ra, rb = _root(parent, int(group[a])), _root(parent, int(group[b]))
            if ra != rb:
                for x in (a, b):
                    if x not in sets_:
                        sets_[x] = _set(packed[x].as_py())
                if similar(sets_[a], sets_[b]):
                    parent[ra] = rb
                    out.append((min(reps[a], reps[b]), max(reps[a], reps[b])))
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


def paths(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` between different components, found in the trees below ``members``.

    ``members`` are ``node, tree, rep, component``; ``classes`` have ``sketch`` and ``roots`` by
    ``rep``, ``texts`` the packed texts.
    """
    detail = classes.select("rep", "sketch", "roots")
    parts = []
    for depth in range(DEPTH + 1):
        sizes = members.groupBy("node").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        members = members.join(sizes.filter("low <> high").select("node", "n"), "node")
        members = tables.stored(members, f"nodes-{depth}")
        fits = members.filter(F.col("n") <= SMALL)
        if depth == 0:
            masks = fits.groupBy("rep").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("tree"))).alias("small"))
        parts.append(fits.select("node", "rep", "component", F.lit(-1).alias("side"), "tree"))
        large = members.filter(F.col("n") > SMALL)
        if depth == DEPTH or not large.take(1):
            break
        place = [F.pmod(F.xxhash64("node", F.lit(j)), F.lit(PLACES)).cast("int") for j in range(BRANCHES)]
        token = F.array(*(F.struct(F.lit(j).alias("j"), F.hex(F.substring("sketch", p + 1, F.lit(1))).alias("t")) for j, p in enumerate(place)))
        split = large.join(detail, "rep").select("node", "rep", "component", F.explode(token).alias("x"))
        members = split.select(F.xxhash64("node", "x.j", "x.t").alias("node"), F.lit(TREES).alias("tree"), "rep", "component").distinct()
    if depth == DEPTH:
        parts.append(_in_blocks(large))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole = whole.join(masks, "rep", "left").withColumn("small", F.coalesce("small", F.lit(0))).join(detail, "rep").select(*NODE)
    schema = "node long, rep long, component long, side int, tree int, small int, sketch binary, roots array<long>"
    involved = tables.stored(whole.repartition("node").sortWithinPartitions("node").mapInArrow(_involved, schema), "involved")
    read = involved.join(texts, "rep").select(*NODE, "packed")
    return read.repartition("node").sortWithinPartitions("node").mapInArrow(_links, "a long, b long")


def _in_blocks(large: DataFrame) -> DataFrame:
    """Nodes that stayed large as pairs of blocks of about half of ``SMALL`` members."""
    blocks = F.ceil(F.col("n") * 2 / SMALL).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit("block")), blocks).cast("int")
    rows = large.select("node", "rep", "component", "tree", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    pair = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(pair.alias("node"), "rep", "component", side.cast("int").alias("side"), "tree")


def _common(sets_: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set but the last, how many members it shares with every set."""
    sizes = [len(s) for s in sets_]
    ends = np.cumsum(sizes)
    number = np.unique(np.concatenate(sets_), return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    holders = np.repeat(np.arange(len(sets_)), sizes)[order]
    bounds = np.searchsorted(number[order], np.arange(number.max() + 2))
    for i in range(len(sets_) - 1):
        lists = [holders[bounds[t] : bounds[t + 1]] for t in number[ends[i] - sizes[i] : ends[i]]]
        yield np.bincount(np.concatenate(lists), minlength=len(sets_))


def _small_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of nodes of small sets, all counted on full sets, unless their ends are connected already."""
    for node in _nodes(batches):
        reps, side = node.column("rep").to_numpy(), node.column("side").to_numpy()
        sets_ = [_set(x.as_py()) for x in node.column("packed")]
        sizes = np.array([len(s) for s in sets_])
        names, group = np.unique(node.column("component").to_numpy(), return_inverse=True)
        parent, out = list(range(len(names))), []
        for i, common in enumerate(_common(sets_)):
            fits = (100 * common >= THRESHOLD * (sizes[i] + sizes - common)) & (group != group[i])
            fits &= (side != side[i]) | (side[i] < 0)
            fits[:i] = False
            for j in np.flatnonzero(fits).tolist():
                ra, rb = _root(parent, int(group[i])), _root(parent, int(group[j]))
                if ra != rb:
                    parent[ra] = rb
                    out.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


def may_be_small(n_shingles: Column) -> Column:
    """Whether a set is small, or of a size that a small one can be similar to."""
    return THRESHOLD * n_shingles <= 100 * (EXACT - 1)


def prefixes(classes: DataFrame, texts: DataFrame, so_far: DataFrame) -> DataFrame:
    """Links ``a, b`` between different components: all pairs of a small set, without sketches.

    Shingles are ordered by the number of sets that have them, then by hash. A set of n goes to
    the nodes of its first n - ceil(n * THRESHOLD / 100) + 1, without those that no other has.
    """
    small = classes.filter(may_be_small(F.col("n_shingles"))).select("rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_ = [_set(x.as_py()) for x in batch.column("packed")]
            if sets_:
                sizes = [len(s) for s in sets_]
                columns = np.repeat(batch.column("rep").to_numpy(), sizes), np.repeat(sizes, sizes), np.concatenate(sets_).view(np.int64)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["rep", "n", "node"])

    tokens = texts.join(small, "rep").select("rep", "packed").mapInArrow(run, "rep long, n long, node long")
    tokens = tables.stored(tokens, "small-shingles")
    often = tokens.groupBy("node").agg(F.count("*").alias("often")).filter("often > 1")
    own = Window.partitionBy("rep")  # EXACT * 4 / 3 rows at most
    met = tokens.join(often, "node").withColumns({
        "alone": F.col("n") - F.count("*").over(own), "at": F.row_number().over(own.orderBy("often", "node")),
    })
    least = F.floor((F.col("n") * THRESHOLD + 99) / 100)
    nodes = met.filter(F.col("alone") + F.col("at") <= F.col("n") - least + 1).select("node", "rep")
    members = nodes.join(so_far, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    members = tables.stored(members.select("node", "rep", "component"), "small-nodes")
    sizes = members.groupBy("node").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    members = members.join(sizes.filter("low <> high").select("node", "n"), "node").withColumn("tree", F.lit(TREES))
    fits = members.filter(F.col("n") <= SMALL).select("node", "rep", "component", F.lit(-1).alias("side"), "tree")
    whole = fits.unionByName(_in_blocks(members.filter(F.col("n") > SMALL)))
    read = whole.join(texts, "rep").select("node", "rep", "component", "side", "packed")
    return read.repartition("node").sortWithinPartitions("node").mapInArrow(_small_links, "a long, b long")


def clusters(docs: DataFrame) -> DataFrame:
    """``doc_id, key_, n_shingles, component_id, kept`` of every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, its own included, and ``kept``
    marks the rows that have it. Null and empty texts, and texts without words, have no
    shingles and are linked with nothing, each its own component. Rows without a doc_id count
    in their class but cannot stand for it: they take its component, or none if the class has
    no id, and are kept only then. Other columns are ignored.
    """
    rows = sets(docs)
    filled = rows.filter("n_shingles > 0")
    # A class is named by its set, so rows that share an id may be in several; its texts are those of one row.
    same_set = filled.filter("doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(
        F.min(F.struct("doc_id", "key_")).alias("one"),
        *(F.any_value(c).alias(c) for c in ("n_shingles", "sketch", "roots")),  # alike in all rows of a set
    )
    classes = tables.stored(same_set.withColumn("rep", F.xxhash64("set_a", "set_b")), "classes")

    first = classes.select("rep", F.posexplode("roots").alias("tree", "token"))
    members = first.select(F.xxhash64("tree", "token").alias("node"), "tree", "rep")
    shared = members.groupBy("node").count().filter("count > 1").select("node")
    members = tables.stored(members.join(shared, "node", "left_semi"), "nodes")
    small = classes.filter(may_be_small(F.col("n_shingles"))).select("rep")
    wanted = classes.join(members.select("rep").union(small).distinct(), "rep", "left_semi")
    texts = _texts_of(docs, wanted)

    star_links = tables.stored(confirmed(stars(members), texts), "star-links")
    so_far = components(star_links)
    placed = members.join(so_far, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    path_links = tables.stored(paths(placed.select("node", "tree", "rep", "component"), classes, texts), "path-links")
    small_links = tables.stored(prefixes(classes, texts, so_far), "small-links")
    joined = components(star_links.union(path_links).union(small_links))

    named = classes.select("rep", "set_a", "set_b", F.col("one.doc_id").alias("first")).join(joined, "rep", "left")
    named = named.withColumn("group", F.coalesce("component", "rep"))
    smallest = named.groupBy("group").agg(F.min("first").alias("smallest"))
    of_class = named.join(smallest, "group").select("set_a", "set_b", F.col("smallest").alias("component"))
    out = rows.select("doc_id", "key_", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "key_", "n_shingles", component.alias("component_id"),
        F.when(component.isNull(), True).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False))).alias("kept"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns.

    Of rows that repeat a doc_id and text one stays; rows kept for want of an id all stay.
    Columns may have any names.
    """
    kept = tables.stored(clusters(docs).filter("kept").select("doc_id", "key_").distinct(), "kept")
    kept_id, kept_key, key, at = tables.unused(docs, "kept_id", "kept_key", "text_key", "at")
    kept = kept.withColumnsRenamed({"doc_id": kept_id, "key_": kept_key})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key))
    found = docs.withColumn(key, tables.text_key()).join(kept, same, "left_semi")
    repeats = Window.partitionBy("doc_id", key).orderBy("doc_id")
    numbered = found.withColumn(at, F.when(F.col("doc_id").isNull(), 1).otherwise(F.row_number().over(repeats)))
    return numbered.filter(F.col(at) == 1).drop(at, key)
