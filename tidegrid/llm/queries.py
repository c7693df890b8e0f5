"""One registered query per operator, over whole tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import (
    best_position,
    context_mixing,
    embedding_dedup,
    merkle,
    minhash_forest,
    mixing,
    packing,
    quality,
    substring_dedup,
    toxicity,
    url_filter,
    vector_graph,
    warc,
)

#: Folder-independent name of the tokenizer file; see ``tokenizer_path``.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.nearest(table(spark, sf_dir, "embeddings"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = context_mixing.score_texts(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    held = F.pmod(F.crc32(F.col("row.doc_id").cast("string")), F.lit(3)) == 1
    return scored.select("row.doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("row.doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_forest.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = merkle.manifest(table(spark, sf_dir, "documents"), changes={"text": lower}, when=tampered, nodes=False)
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    held = F.pmod(F.crc32(F.col("row.doc_id").cast("string")), F.lit(5)) == 0
    return scored.select("row.doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op13_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_position.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_vector_graph,
        op2_warc,
        op3_context_mixing,
        op4_toxicity,
        op5_embedding_near_dedup,
        op6_mixing,
        op7_substring_dedup,
        op8_packing,
        op9_minhash_forest,
        op10_url_filter,
        op11_merkle_manifest,
        op12_quality,
        op13_best_position,
    )
}

def _crc_nibbles() -> list[int]:
    """Steps of the reflected CRC-32 for four bits at a time."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text in DuckDB."""
    codes = f"list_transform(range(1, 2 * length({text}) + 1), lambda k: (ascii({text}[(k + 1) // 2]) >> (4 * ((k + 1) % 2))) & 15)"
    step = f"lambda c, b: xor(c >> 4, {_crc_nibbles()}[(xor(c, b) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform({codes}, lambda b: b::bigint)), {step}), 4294967295)"


def _part_sql(name: str) -> str:
    return f"coalesce(concat(strlen({name}::varchar), ':', {name}::varchar), '-')"


_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF_SQL = "sha256(" + " || ".join(_part_sql(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

# five hex digits are four letters of base32
_BASE32_SQL = """list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr({hex}, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31))::bigint, 1)), 'string_agg', '')"""
_WORDS_SQL = "coalesce(len(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')), 0)"

ORACLES: dict[str, str] = {
    "op2_warc": f"""
with page as (select page_id, coalesce(html, '') as payload from pages),
first as (select payload, min(page_id) as first from page group by payload)
select page_id, strlen(payload) as payload_bytes, {_BASE32_SQL.format(hex="sha1(payload)")} as payload_digest,
       case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when first is null or page_id is not distinct from first then null else first end as refers_to
from page join first using (payload)""",
    "op6_mixing": f"""
with doc as materialized (
  select row_number() over () as row, doc_id, source, md5(text) as digest, {_WORDS_SQL.format(text="text")}::bigint as size from documents),
src as materialized (
  select *, [5.0::double, 2.0, 1.0][1 + turn % 3] as weight, 2.0::double * source_size as cap
  from (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as turn from doc group by source)),
-- the level of all that is left after filling the sources before; the first source that it does not fill ends the filling
level as (
  select a.source, 1.5::double * (select sum(source_size) from src)
         - coalesce(sum(b.cap) filter (where b.cap / b.weight < a.cap / a.weight or b.cap / b.weight = a.cap / a.weight and b.turn < a.turn), 0)
         as rest,
         sum(b.weight) filter (where b.cap / b.weight > a.cap / a.weight or b.cap / b.weight = a.cap / a.weight and b.turn >= a.turn) as weights
  from src a, src b group by a.source, a.cap, a.weight, a.turn),
target as materialized (
  select source, source_size, least(cap, coalesce(weight * (
           select arg_max(rest / weights, weights) from level l join src s on l.source is not distinct from s.source where cap > rest / weights * weight), cap)) as target
  from src),
part as materialized (
  select row, doc_id, digest, size, source_size, target, coalesce(target / nullif(source_size, 0), 0) as ratio,
         ratio - floor(ratio) as f, f * source_size as want, d.source
  from doc d join target t on d.source is not distinct from t.source),
draw as (
  select *, u / (1 - u) * (1 - f) / f as odds, odds / (1 + odds) as rank
  from (select *, (('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::varchar, '-'), size::varchar, digest)), 1, 12))::bigint + 0.5::double)
                  / 281474976710656.0::double as u from part where f > 0 and size > 0)),
filled as (
  select row, size, want, sum(size) over (partition by source order by rank, doc_id::varchar, size, digest, row) - size as before from draw)
select doc_id, p.size, source_size, target,
       p.size * (floor(ratio)::bigint + (f.before is not null and f.before < f.want and f.before + f.size - f.want <= f.want - f.before)::bigint) as taken
from part p left join filled f using (row)""",
    "op11_merkle_manifest": f"""
with recursive doc as materialized (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i,
         count(*) over (partition by lang) as n, dense_rank() over (order by lang nulls first) - 1 as g
  from (select doc_id, lang, {_LEAF_SQL.format(text="text")} as leaf,
               case when {crc32_sql("cast(doc_id as varchar)")} % 3 = 0 then {_LEAF_SQL.format(text=_LOWER_SQL)} end as changed
        from documents)),
node(g, level, i, n, d) as (
  select g, 0, i, n, leaf from doc
  union all
  select g, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' order by i)) from node where n > 1 group by g, level, i // 8, n),
tree as materialized (select * from node),
sub as materialized (select g, level as height, d as subroot from tree where n = 1),
upper(level, i, n, d) as (
  select 0, g, (select count(*) from sub), subroot from sub
  union all
  select level + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' order by i)) from upper where n > 1 group by level, i // 8, n),
top as materialized (select * from upper),
run as materialized (
  select d.g, d.i, t.level, coalesce(string_agg(t.d, '' order by t.i) filter (where t.i < (d.i >> (3 * t.level))), '') as before,
         coalesce(string_agg(t.d, '' order by t.i) filter (where t.i > (d.i >> (3 * t.level))), '') as after
  from doc d join tree t on t.g = d.g and t.n > 1 and t.i // 8 = (d.i >> (3 * t.level + 3)) group by d.g, d.i, t.level
  union all
  select d.g, d.i, height + t.level, coalesce(string_agg(t.d, '' order by t.i) filter (where t.i < (d.g >> (3 * t.level))), ''),
         coalesce(string_agg(t.d, '' order by t.i) filter (where t.i > (d.g >> (3 * t.level))), '')
  from doc d join sub on sub.g = d.g join top t on t.n > 1 and t.i // 8 = (d.g >> (3 * t.level + 3)) group by d.g, d.i, height + t.level),
fold(g, i, level, d) as (
  select g, i, 0, coalesce(changed, leaf) from doc
  union all
  select f.g, f.i, f.level + 1, sha256(r.before || f.d || r.after) from fold f join run r using (g, i, level)),
done as (select g, i, arg_max(d, level) as d from fold group by g, i),
proof as (select g, i, sha256(string_agg(before || after, '' order by level)) as h from run group by g, i)
select doc_id, leaf, subroot, root, coalesce(h, sha256('')) as proof_sha256, done.d as folded_root, done.d = root as verified
from doc join sub using (g) join done using (g, i) left join proof using (g, i), (select d as root from top where n = 1)""",
    "op13_best_position": f"""
with word as materialized (
  select row, doc_id, unnest(regexp_extract_all({_LOWER_SQL}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) as term
  from (select row_number() over () as row, * from documents)),
doc as materialized (select row, doc_id, count(*) as n from word group by row, doc_id),
total as (select count(*) as docs, sum(n)::bigint as words from doc),
asked as materialized (
  select ask, item_id, term, count(*) as times
  from (select ask, item_id, unnest(regexp_extract_all({_LOWER_SQL}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) as term
        from (select row_number() over () as ask, * from benchmark)) group by all),
held as materialized (select row, term, count(*) as tf from word where term in (select term from asked) group by row, term),
weight as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from held, total group by term, docs),
impact as materialized (
  select row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words))) as part
  from held join weight using (term) join doc using (row), total),
scored as (
  select ask, item_id, doc_id, row, sum(part * times)::bigint as score from asked join impact using (term) group by all)
select item_id, rank, doc_id, score
from (select *, row_number() over (partition by ask order by score desc, doc_id nulls last, row) as rank from scored where score > 0)
where rank <= 20""",
    "op5_embedding_near_dedup": """
with recursive raw as (
  select vec_id, cast(embedding as double[]) as v from embeddings where embedding is not null),
vec as (
  select vec_id, v, sqrt(list_inner_product(v, v)) as norm from raw
  where len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(v) > 0 and list_inner_product(v, v) > 0),
link as materialized (
  select a.vec_id as a, b.vec_id as b from vec a join vec b on a.vec_id <> b.vec_id
  where list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on l.a = r.b)
select e.vec_id, coalesce(n.n, 0) as n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) as component_id,
       least(e.vec_id, coalesce(c.low, e.vec_id)) = e.vec_id as kept
from embeddings e
left join (select a, count(*) as n from link group by a) n on n.a = e.vec_id
left join (select a, min(b) as low from reach group by a) c on c.a = e.vec_id""",
}
