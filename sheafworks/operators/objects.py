"""Document objects: revisions, inheritance, reachability, renumbering, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafworks.functions.tables import cut, drop, fresh, ranked


def distinct_shared(resources: DataFrame) -> DataFrame:
    return resources.dropDuplicates(["doc_id", "obj_num"])


def latest_revision(revisions: DataFrame) -> DataFrame:
    """The newest entry in use of each object; free entries don't count. Ties go to the larger offset."""
    newest = F.max_by(F.struct("section", "byte_offset"), F.struct("section", "byte_offset"))
    return revisions.where("in_use").groupBy("doc_id", "obj_num").agg(newest.alias("r")).select("doc_id", "obj_num", "r.section", "r.byte_offset")


def first_value_per_key(sections: DataFrame) -> DataFrame:
    """The value of the newest section that has the key."""
    return sections.groupBy("doc_id", "info_key").agg(F.max_by("info_value", F.struct("section", "tie")).alias("info_value"))


def compact_ids(objects: DataFrame) -> DataFrame:
    """Adds new_id 1..N by ascending number within each document, of which one may hold most of all objects."""
    return ranked(objects, ["doc_id"], ["obj_num"], "new_id").withColumn("new_id", F.col("new_id").cast("int"))


def inherit_page_attrs(tree: DataFrame, attrs: list[str]) -> DataFrame:
    """(node_id, attrs): a node's own value, else that of its nearest ancestor, however deep the tree (node_id, parent_id).

    Inner nodes take over what their pointer's target has, and its pointer, so that a round looks twice as far up as the
    one before: the rounds are the logarithm of the depth. All other nodes are joined once, with their parents. A parent
    that is not in the table ends the way up; nodes that are their own ancestors are an error.
    """
    up, node, further, *values = fresh(tree, "up", "node", "further", *[f"{a}_above" for a in attrs])
    above = lambda t: t.select(F.col("node_id").alias(node), F.col(up).alias(further), *[F.col(a).alias(v) for a, v in zip(attrs, values, strict=True)])
    filled = [F.coalesce(F.col(a), F.col(v)).alias(a) for a, v in zip(attrs, values, strict=True)]
    parents = tree.select(F.col("parent_id").alias(node)).where(F.col(node).isNotNull()).distinct()
    inner = cut(tree.join(parents, F.col("node_id") == F.col(node), "left_semi").select("node_id", F.col("parent_id").alias(up), *attrs))
    n, seen = inner.count(), 1
    while not inner.where(F.col(up).isNotNull()).isEmpty():
        if seen > n:  # n nodes without a cycle have no way of n steps
            raise ValueError("a node is its own ancestor")
        last, inner = inner, cut(inner.join(above(inner), F.col(up) == F.col(node), "left").select("node_id", F.col(further).alias(up), *filled))
        drop(last)
        seen *= 2
    return tree.join(above(inner), F.col("parent_id") == F.col(node), "left").select("node_id", *filled)


#: Steps of a round while the frontier is thin, and how many nodes make it thin.
STEPS, THIN = 16, 10_000


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) of all that roots need: Parent edges are ignored, shared nodes come once, cycles end.

    Each round joins the frontier only and writes only what is new. What was found lies in tables of which each is more
    than twice as large as the next: a new table takes in those that are not, so that a node is written anew once each
    time its table doubles, and the look for known nodes reads few tables. While the frontier is thin, as in long chains,
    a round takes up to STEPS steps. Spent tables are deleted.
    """
    edges = cut(edges.where("kind <> 'Parent'").select("src", "dst").distinct())
    frontier = cut(roots.select("node").distinct())
    n, steps, tables, sizes = frontier.count(), 1, [frontier], []
    sizes.append(n)
    while n:
        steps = min(STEPS, 2 * steps) if n <= THIN else 1
        found = frontier.select("node", F.lit(True).alias("open"))
        for _ in range(steps):  # open nodes are those that this round has not joined yet
            both = F.array(F.struct("node", F.lit(False).alias("open")), F.struct(F.col("dst").alias("node"), F.lit(True).alias("open")))
            found = found.join(edges, F.col("open") & (F.col("node") == F.col("src")), "left").select(F.inline(both)).where("node is not null").groupBy("node").agg(F.bool_and("open").alias("open"))
        found = found.select("node")
        for t in tables:
            found = found.join(t, "node", "left_anti")
        spent = frontier if frontier is not tables[-1] else None
        frontier = cut(found)
        n = frontier.count()
        if spent is not None:
            drop(spent)
        if not n:
            drop(frontier)
            break
        tables, sizes = [*tables, frontier], [*sizes, n]
        merged = 1
        while merged < len(sizes) and sizes[-merged - 1] <= 2 * sum(sizes[-merged:]):
            merged += 1
        if merged > 1:
            some = tables[-merged:]
            whole = some[0]
            for t in some[1:]:
                whole = whole.unionByName(t)
            tables, sizes = [*tables[:-merged], cut(whole)], [*sizes[:-merged], sum(sizes[-merged:])]
            drop(*[t for t in some if t is not frontier])
    drop(edges)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def remap_refs(edges: DataFrame, id_map: DataFrame) -> DataFrame:
    """Adds new_dst; null where the target has no new id. id_map: (old_id, new_id)."""
    old, new = fresh(edges, "old", "new")
    ids = id_map.select(F.col("old_id").alias(old), F.col("new_id").alias(new))
    return edges.join(ids, F.col("dst") == F.col(old), "left").select(*edges.columns, F.col(new).alias("new_dst"))


def overlay_updates(base: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Updated rows replace those with their key, new keys are added."""
    return base.join(updates.select(*key), key, "left_anti").select(*base.columns).unionByName(updates.select(*base.columns))


def object_listing(base: DataFrame, updates: DataFrame) -> DataFrame:
    """(doc_id, obj_num) of both, once each, ascending."""
    return base.select("doc_id", "obj_num").union(updates.select("doc_id", "obj_num")).distinct().orderBy("doc_id", "obj_num")
