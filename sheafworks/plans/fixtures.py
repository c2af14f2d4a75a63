"""Base tables of the library, derived from the driver's tables: as DataFrames and, for the oracles, as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafworks.functions.tables import read
from sheafworks.operators.pages import paginate

TERMS = ["the", "tion", " ", "EAU"]
#: More terms than are put into a plan: pairs of syllables, in blanks and either case.
SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "eau", "ou", "è", "ê", "ç", "ñ", "ß", "ung", "ti"]
MANY_TERMS = [f"\t{(a + b).upper()}\n" if (i + j) % 2 else f"\xa0 {a + b}" for i, a in enumerate(SYLLABLES) for j, b in enumerate(SYLLABLES)]

VIEWS = {
    "doc_pages": "select doc_id, cast(i as int) as page_no, substr(text, (i-1)*500+1, 500) as page_text from (select doc_id, text, unnest(generate_series(1, greatest(1, (length(text)+499)//500))) as i from documents)",
    "text_runs": """select doc_id, cast(line_no//40 + 1 as int) as page_no, line_no*100000 + word_no as run_seq, word as run_text, 10e0 as font_size, 50e0 + 60e0*word_no as x, 760e0 - 14e0*(line_no % 40) as y, 50e0 + 60e0*word_no + 5e0*length(word) as end_x
from (select doc_id, line_no, unnest(split(line, ' ')) as word, generate_subscripts(split(line, ' '), 1) - 1 as word_no from (select doc_id, unnest(split(text, chr(10))) as line, generate_subscripts(split(text, chr(10)), 1) - 1 as line_no from documents)) where length(word) > 0""",
    "run_items": "select doc_id, page_no, y as line_y, run_seq as item_no, run_text as piece, cast(-((run_seq * 97) % 300) as double) as adjust from text_runs",
    "page_boxes": """select doc_id, page_no, case when page_no % 7 = 0 then null else 0e0 end as llx, case when page_no % 7 = 0 then null else 0e0 end as lly,
case when page_no % 7 = 0 then null else cast(595 + (doc_id % 3)*17 as double) end as urx, case when page_no % 7 = 0 then null else cast(842 - (doc_id % 5)*10 as double) end as ury,
cast((doc_id*37 + page_no*11) % 720 - 360 as int) as rotate from doc_pages""",
    "boxes": "select doc_id, page_no, case when llx is null then 0e0 else llx end as llx, case when lly is null then 0e0 else lly end as lly, case when urx is null then 612e0 else urx end as urx, case when ury is null then 792e0 else ury end as ury, rotate from page_boxes",
    "page_tree": """select 'r'||r_regionkey as node_id, null as parent_id, 1 as level, 600 + r_regionkey as media_w, null::int as rotate from region
union all select 'n'||n_nationkey, 'r'||n_regionkey, 2, case when n_nationkey % 3 = 0 then 500 + n_nationkey end, case when n_nationkey % 4 = 0 then 90 end from nation
union all select 'c'||c_custkey, 'n'||c_nationkey, 3, cast(case when c_custkey % 5 = 0 then 400 + c_custkey % 100 end as int), case when c_custkey % 7 = 0 then 180 end from customer""",
    "object_revisions": "select o_custkey as doc_id, o_orderkey % 5 as obj_num, o_orderdate as section, o_orderkey as byte_offset, o_orderstatus <> 'F' as in_use from orders",
    "doc_info_sections": "select o_custkey as doc_id, o_orderpriority as info_key, o_orderdate as section, o_orderkey as tie, cast(o_orderkey as varchar) as info_value from orders",
    "object_edges": """select 'o'||o_orderkey as src, 'c'||o_custkey as dst, 'Resources' as kind from orders union all select 'c'||c_custkey, 'n'||c_nationkey, 'Font' from customer
union all select 'n'||n_nationkey, 'r'||n_regionkey, 'Font' from nation union all select 'n'||n_nationkey, 'n'||((n_nationkey + 5) % 25), 'Next' from nation union all select 'r'||n_regionkey, 'o'||n_nationkey, 'Parent' from nation""",
    "resources": "select l_orderkey as doc_id, l_partkey % 50 as obj_num from lineitem",
    "doc_info": "select c_custkey as doc_id, c_name as title, c_mktsegment as author, case when c_acctbal < 0 then '' else 'balance' end as subject, cast(c_nationkey as varchar) as keywords, '' as creator, 'producer' as producer from customer",
    "color_ops": """select op_id, op, list_transform(range(0, n), lambda j: cast((op_id*(7+4*j)) % 101 as double)/cast(100 as double)) as args from (select o_orderkey as op_id, (['rg','RG','k','K','sc','SCN','re','gs'])[o_orderkey % 8 + 1] as op,
case o_orderkey % 8 when 0 then 3 when 1 then 3 when 2 then 4 when 3 then 4 when 6 then 4 when 7 then 0 else (o_orderkey // 8) % 4 + 1 end as n from orders)""",
    "pixels": """select vec_id as image_id, cast(p % 8 as int) as x, cast(p // 8 as int) as y, c[p+1] as r, c[(p+21) % 64 + 1] as g, c[(p+42) % 64 + 1] as b, case when (p % 8 + p // 8) % 5 = 0 then 128 else 255 end as a
from (select vec_id, c, unnest(range(0, 64)) as p from (select vec_id, list_transform(embedding, lambda v: cast(least(255, greatest(0, floor((cast(v as double)+1e0)*127.5e0))) as int)) as c from embeddings))""",
    "mixed_dims": "select vec_id as image_id, cast(4 + vec_id % 5 as int) as width, cast(3 + vec_id % 6 as int) as height from embeddings",
    "mixed_pixels": "select p.image_id, cast((p.y*8 + p.x) % d.width as int) as x, cast((p.y*8 + p.x) // d.width as int) as y, r, g, b, a from pixels p join mixed_dims d on p.image_id = d.image_id where p.y*8 + p.x < d.width*d.height",
    "image_dims": "select p_partkey as image_id, p_name||'.png' as name, p_size*40 as width, cast((p_partkey % 37 + 1)*30 as int) as height, p_partkey*13 + 1000 as size_before, (p_partkey*7919) % 30000 as size_after, (['image/png','image/jpeg','image/webp','image/gif'])[p_partkey % 4 + 1] as mime, cast(p_partkey % 10 as int) as orientation from part",
    "clicks": "select event_id, user_id, ts, event_id % (select count(*) from embeddings) as image_id, value/400e0 as fx, cast(event_id % 97 as double)/90e0 as fy from events",
    "samples": "select user_id as row_id, row_number() over (partition by user_id order by ts, event_id) as pos, cast(floor(value) as int) % 256 as delta from events",
    "entries": "select source as archive, doc_id as entry_no, 'doc-'||doc_id||'.txt' as name, strlen(text) as size, (strlen(text)*(doc_id % 13))//10 as compressed_size, text as data from documents",
    "catalog": "select cast(p_partkey as varchar) as slug, p_type as category, p_name as title, p_brand as description, case when p_size > 5 then 'ready' else 'planned' end as status from part",
}


def sql(body: str, *names: str) -> str:
    """body with the views that it names, and those they need, put before it."""
    need: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and re.search(rf"(from|join) {other}\b", VIEWS[name]) and other not in need:
                add(other)
        if name not in need:
            need.append(name)

    for n in names:
        add(n)
    return "with recursive " + ", ".join(f"{n} as ({VIEWS[n]})" for n in need) + " " + body


def doc_pages(spark: SparkSession, d: str) -> DataFrame:
    return paginate(read(spark, d, "documents"), 500)


def text_runs(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    words = lines.select("doc_id", F.col("line_no").cast("long"), F.posexplode(F.split("line", " ", -1)).alias("word_no", "word")).where(F.length("word") > 0)
    x = F.lit(50.0) + F.lit(60.0) * F.col("word_no")
    return words.select(
        "doc_id", (F.floor(F.col("line_no") / 40) + 1).cast("int").alias("page_no"), (F.col("line_no") * 100000 + F.col("word_no")).alias("run_seq"), F.col("word").alias("run_text"),
        F.lit(10.0).alias("font_size"), x.alias("x"), (F.lit(760.0) - F.lit(14.0) * (F.col("line_no") % 40)).alias("y"), (x + F.lit(5.0) * F.length("word")).alias("end_x"),
    )


def run_items(spark: SparkSession, d: str) -> DataFrame:
    return text_runs(spark, d).select("doc_id", "page_no", F.col("y").alias("line_y"), F.col("run_seq").alias("item_no"), F.col("run_text").alias("piece"), (-((F.col("run_seq") * 97) % 300)).cast("double").alias("adjust"))


def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    p = doc_pages(spark, d)
    boxed = lambda v, name: F.when(F.col("page_no") % 7 != 0, v.cast("double")).alias(name)
    return p.select("doc_id", "page_no", boxed(F.lit(0.0), "llx"), boxed(F.lit(0.0), "lly"), boxed(595 + (F.col("doc_id") % 3) * 17, "urx"), boxed(842 - (F.col("doc_id") % 5) * 10, "ury"), ((F.col("doc_id") * 37 + F.col("page_no") * 11) % 720 - 360).cast("int").alias("rotate"))


def page_tree(spark: SparkSession, d: str) -> DataFrame:
    node = lambda c, prefix: F.concat(F.lit(prefix), F.col(c).cast("string"))
    r = read(spark, d, "region").select(node("r_regionkey", "r").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("level"), (600 + F.col("r_regionkey")).cast("int").alias("media_w"), F.lit(None).cast("int").alias("rotate"))
    n = read(spark, d, "nation").select(node("n_nationkey", "n"), node("n_regionkey", "r"), F.lit(2), F.when(F.col("n_nationkey") % 3 == 0, 500 + F.col("n_nationkey")).cast("int"), F.when(F.col("n_nationkey") % 4 == 0, 90))
    c = read(spark, d, "customer").select(node("c_custkey", "c"), node("c_nationkey", "n"), F.lit(3), F.when(F.col("c_custkey") % 5 == 0, 400 + F.col("c_custkey") % 100).cast("int"), F.when(F.col("c_custkey") % 7 == 0, 180))
    return r.union(n).union(c)


def object_revisions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 5).alias("obj_num"), F.col("o_orderdate").alias("section"), F.col("o_orderkey").alias("byte_offset"), (F.col("o_orderstatus") != "F").alias("in_use"))


def doc_info_sections(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("info_key"), F.col("o_orderdate").alias("section"), F.col("o_orderkey").alias("tie"), F.col("o_orderkey").cast("string").alias("info_value"))


def object_edges(spark: SparkSession, d: str) -> DataFrame:
    node = lambda c, prefix: F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))
    n = read(spark, d, "nation")
    out = read(spark, d, "orders").select(node("o_orderkey", "o").alias("src"), node("o_custkey", "c").alias("dst"), F.lit("Resources").alias("kind"))
    out = out.union(read(spark, d, "customer").select(node("c_custkey", "c"), node("c_nationkey", "n"), F.lit("Font")))
    out = out.union(n.select(node("n_nationkey", "n"), node("n_regionkey", "r"), F.lit("Font"))).union(n.select(node("n_nationkey", "n"), node((F.col("n_nationkey") + 5) % 25, "n"), F.lit("Next")))
    return out.union(n.select(node("n_regionkey", "r"), node("n_nationkey", "o"), F.lit("Parent")))


def resources(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 50).alias("obj_num"))


def doc_info(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, info): a map without empty fields."""
    c = read(spark, d, "customer")
    fields = {"Title": F.col("c_name"), "Author": F.col("c_mktsegment"), "Subject": F.when(F.col("c_acctbal") < 0, "").otherwise("balance"), "Keywords": F.col("c_nationkey").cast("string"), "Creator": F.lit(""), "Producer": F.lit("producer")}
    info = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    return c.select(F.col("c_custkey").alias("doc_id"), F.map_filter(info, lambda _, v: v != "").alias("info"))


def color_ops(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    op = F.element_at(F.array(*[F.lit(x) for x in ("rg", "RG", "k", "K", "sc", "SCN", "re", "gs")]), (k % 8 + 1).cast("int"))
    n = F.when((k % 8).isin(0, 1), 3).when((k % 8).isin(2, 3, 6), 4).when(k % 8 == 7, 0).otherwise((F.floor(k / 8) % 4 + 1).cast("int"))
    args = F.transform(F.slice(F.array(*[F.lit(j) for j in range(4)]), 1, n), lambda j: ((k * (7 + 4 * j)) % 101).cast("double") / F.lit(100.0))
    return read(spark, d, "orders").select(k.alias("op_id"), op.alias("op"), args.alias("args"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    c = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1.0) * 127.5))).cast("int"))
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), c.alias("c"))
    p = F.col("p")
    at = lambda k: F.get("c", (p + k) % 64)
    e = e.select("image_id", "c", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    x, y = p % 8, F.floor(p / 8).cast("int")
    return e.select("image_id", x.alias("x"), y.alias("y"), at(0).alias("r"), at(21).alias("g"), at(42).alias("b"), F.when((x + y) % 5 == 0, 128).otherwise(255).alias("a"))


def pixel_dims(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"))


def mixed_dims(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of several sizes."""
    k = F.col("vec_id")
    return read(spark, d, "embeddings").select(k.alias("image_id"), (4 + k % 5).cast("int").alias("width"), (3 + k % 6).cast("int").alias("height"))


def mixed_pixels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("y") * 8 + F.col("x")
    p = pixels(spark, d).join(mixed_dims(spark, d), "image_id").where(n < F.col("width") * F.col("height"))
    return p.select("image_id", (n % F.col("width")).alias("x"), F.floor(n / F.col("width")).cast("int").alias("y"), "r", "g", "b", "a")


def rasters(spark: SparkSession, d: str) -> DataFrame:
    """One row for each picture: width, height and row-major channel arrays."""
    c = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1.0) * 127.5))).cast("int"))
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), c.alias("c"))
    turned = lambda k: F.concat(F.slice("c", k + 1, 64 - k), F.slice("c", 1, k))
    alpha = F.array(*[F.lit(128 if (p % 8 + p // 8) % 5 == 0 else 255) for p in range(64)])
    return e.select("image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("c").alias("r"), turned(21).alias("g"), turned(42).alias("b"), alpha.alias("a"))


def image_dims(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    mime = F.element_at(F.array(*[F.lit(x) for x in ("image/png", "image/jpeg", "image/webp", "image/gif")]), (k % 4 + 1).cast("int"))
    return read(spark, d, "part").select(
        k.alias("image_id"), F.concat("p_name", F.lit(".png")).alias("name"), (F.col("p_size") * 40).alias("width"), ((k % 37 + 1) * 30).cast("int").alias("height"),
        (k * 13 + 1000).alias("size_before"), ((k * 7919) % 30000).alias("size_after"), mime.alias("mime"), (k % 10).cast("int").alias("orientation"),
    )


def clicks(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "embeddings").count()
    return read(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_id") % n).alias("image_id"), (F.col("value") / 400.0).alias("fx"), ((F.col("event_id") % 97).cast("double") / 90.0).alias("fy"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return read(spark, d, "events").select(F.col("user_id").alias("row_id"), pos.alias("pos"), (F.floor("value").cast("int") % 256).alias("delta"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    return read(spark, d, "documents").select(F.col("source").alias("archive"), F.col("doc_id").alias("entry_no"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), size.alias("size"), F.floor(size * (F.col("doc_id") % 13) / 10).alias("compressed_size"), F.encode("text", "UTF-8").alias("data"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("slug"), F.col("p_type").alias("category"), F.col("p_name").alias("title"), F.col("p_brand").alias("description"), F.when(F.col("p_size") > 5, "ready").otherwise("planned").alias("status"))


