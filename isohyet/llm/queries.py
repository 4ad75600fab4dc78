"""The thin queries opN_<name>: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm import centroids, exact_dedup, fill_in_middle, language_id, line_dedup, media, near_dedup, packing, sentencepiece_codec, sharding, suffix_dedup, token_store, toxicity
from isohyet.llm.common import new_folder, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = sentencepiece_codec.encode(table(spark, sf_dir, "documents"))
    return sentencepiece_codec.decode(ids).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(F.coalesce(~held_out(), F.lit(True))))
    return language_id.predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", line_dedup.host_of(F.col("url")).alias("host"), line_dedup.lines_of_html(F.col("html")).alias("text"))
    return line_dedup.drop_boilerplate(pages)


OP3_SQL = rf"""
with pages_ as (
  select page_id, coalesce(cast(page_id as varchar), 'row ' || row_number() over ()) as page, lower(regexp_extract(url, '{line_dedup.HOST_PATTERN}', 1)) as host,
    string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', chr(10), 'g'),
      '(?i)</?(?:{line_dedup.BLOCKS})(?:[ 	
/][^>]*)?>', chr(10), 'g'),
      '<[^>]*>', '', 'g'),
      '[ 	
]*
[ 	
]*', chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10)), chr(10)) as lines
  from pages),
line_ as (select page, host, unnest(lines) as line from pages_),
often as (select host, line, count(distinct page) as n from line_ where line <> '' group by host, line having count(distinct page) >= {line_dedup.LEAST_PAGES}),
totals as (select host, count(distinct page) as pages from pages_ group by host),
common as (select host, list(line) as common from often join totals using (host) where n > {line_dedup.RATIO} * pages group by host),
kept as (select page_id, host, len(lines) as n_lines, case when common is null then lines else list_filter(lines, lambda x: not list_contains(common, x)) end as kept
  from pages_ left join common using (host))
select page_id, host, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(len(kept), 0) as bigint) as n_kept, case when len(kept) = 0 then '' else array_to_string(kept, chr(10)) end as text
from kept
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP5_SQL = """
with rows_ as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
groups_ as (select norm, max(doc_id) as keep_id, count(*) as group_size from rows_ group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from rows_ join groups_ using (norm)
"""


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.load(media.store(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP7_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as v from s),
links as (select a.doc_id as a, b.doc_id as b from e a join e b on a.v = b.v and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by 1, 2, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, x.b from reach r join edges x on x.a = r.other),
found as (select doc_id, min(other) as component_id from reach group by 1)
select s.doc_id, len(s) as n_shingles, component_id, s.doc_id = component_id as kept from s join found using (doc_id)
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"))
    stored = token_store.read_all(spark, manifest)
    return stored.select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for windows of 400 bytes; and `text`, which also lacks repeated passages of over 50 words."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), words=51)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text")

def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    characters = toxicity.fit_characters(docs)
    model = toxicity.fit(docs, labels, characters)
    return toxicity.score(docs, model).select("doc_id", out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
with units as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, sha256('42:' || doc_id) as h from documents),
draws as (select doc_id, text, u, len(u) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from units),
cuts as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from draws),
parts as (select doc_id, text, n, form, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from cuts)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256
from parts
"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    components = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(components, 256).alias("centroid_sha256"))


def _op13_sql(k: int = 16, rounds: int = 3) -> str:
    far = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    steps = [
        "v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)",
        f"c0 as (select row_number() over (order by h, v) - 1 as j, v from (select sha256('1:' || vec_id) as h, v from v order by h, v limit {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} as (select vec_id, x.v as v, min(struct_pack(d := cast({far} as bigint), j := c.j)) as best from v x, c{r} c group by vec_id, x.v)")
        if r < rounds:
            mean = "list_transform(range(1, 65), lambda i: (s[i] - ((s[i] % n) + n) % n) // n)"
            added = ", ".join(f"sum(v[{i}])" for i in range(1, 65))
            steps.append(f"m{r} as (select best.j as j, count(*) as n, [{added}] as s from a{r} group by best.j)")
            steps.append(f"c{r + 1} as (select c.j, case when n is null then c.v else list_transform({mean}, lambda x: cast(x as bigint)) end as v from c{r} c left join m{r} using (j))")
    return f"""with {", ".join(steps)}
select vec_id, cast(best.j as integer) as cluster, best.d as distance, cast(sum(best.d) over (partition by best.j) as bigint) as cluster_inertia, cast(sum(best.d) over () as bigint) as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} join c{rounds} c on c.j = best.j"""


OP13_SQL = _op13_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_language, op3_line_dedup, op4_packing, op5_exact_dedup, op6_media, op7_near_dedup, op8_sharding, op9_token_store, op10_suffix_dedup, op11_toxicity, op12_fill_in_middle, op13_centroids)
}
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op7_near_dedup": OP7_SQL, "op12_fill_in_middle": OP12_SQL, "op13_centroids": OP13_SQL}
