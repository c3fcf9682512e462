"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.llm import attention_quality
from ratelake.llm.decontamination import contaminated
from ratelake.llm.language_id import in_holdout, language_spans, learn
from ratelake.llm.license_scan import scan_licenses
from ratelake.llm.merkle_manifest import manifest, proofs
from ratelake.llm.piece_codec import encode_decode_digests
from ratelake.llm.quality_rules import quality_verdicts
from ratelake.llm.repeats import remove_repeats
from ratelake.llm.rows import table
from ratelake.llm.simhash import near_duplicates
from ratelake.llm.token_alignment import aligned_documents
from ratelake.llm.token_counts import token_counts
from ratelake.llm.token_store import lookup_rows, shard_starts, stored_digests, write_store
from ratelake.llm.url_filter import filter_captures, host_of
from ratelake.sources.shared import shared_folder


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, sf_dir, "documents"), path, limit=1024)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies comes from the index, its checksum from the payload there."""
    docs, path = table(spark, sf_dir, "documents"), shared_folder(spark, "token-store")
    write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return indexed_digests(spark, path, docs)


def indexed_digests(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """The contract's columns of all rows of the keys of docs."""
    at = ["shard", "segment", "place", "n_tokens"]
    stored = stored_digests(spark, path).select(*at, "offset", "ids_crc32")
    held = lookup_rows(spark, path, docs).join(stored, at)
    return held.join(shard_starts(spark, path), "shard").select(
        "doc_id",
        (F.col("base") + F.col("offset")).alias("start"),
        "n_tokens",
        "ids_crc32",
        F.col("rows").alias("rows_of_key"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures and list entries come from the pages: their instants are hashes of keys."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", _instant(F.concat("url", F.lit("@"))))
    entries = _entries(pages)
    found = filter_captures(captures, entries)
    return found.select(
        "page_id",
        "url",
        F.unix_seconds("fetched_at").alias("fetched_at"),
        "blocked",
        "entry",
        F.unix_seconds("since").alias("since"),
    )


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _instant(text: Column) -> Column:
    """An instant of the year 2024 that the text decides."""
    return F.timestamp_seconds(1704067200 + _number(text) % 31536000)


def _entries(pages: DataFrame) -> DataFrame:
    """Dated entries for hosts (up to four each) and for the domains above them (two)."""
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key is not null").distinct()
    domains = hosts.select(F.regexp_extract("key", r"([^.]+\.[^.]+)$", 1).alias("key"))
    out = []
    for keys, mark, count, one_in in ((hosts, "#", 4, 3), (domains.distinct(), "##", 2, 2)):
        each = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"))
        name = F.concat("key", F.lit(mark), F.col("i").cast("string"))
        each = each.where(_number(name) % one_in != 0)
        listed = _number(F.concat(name, F.lit("!"))) % 2 == 0
        out.append(each.select("key", listed.alias("listed"), _instant(name).alias("since")))
    return out[0].unionByName(out[1])


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id", "linked")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_verdicts(docs, labels)


def op9_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_decode_digests(table(spark, sf_dir, "documents"), path)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~in_holdout("doc_id")))
    found = language_spans(docs, model)
    return found.select("doc_id", in_holdout("doc_id").alias("held_out"), "lang_pred", "score")


def op11_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = attention_quality.learn(docs, labels, allowed=~held_out)
    found = attention_quality.score_quality(docs, model)
    return found.withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("byte_bpe_50k.json", "piece_bpe_32k.model")
    first, second = map(public_tokenizers.path, names)
    return aligned_documents(table(spark, sf_dir, "documents"), (first, second))


#: The columns that a leaf of the manifest covers.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def tampered(docs: DataFrame) -> tuple[Column, list[Column]]:
    """Every seventh document, by a checksum of its id, with one character more claimed."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return hit, [more if name == "n_chars" else F.col(name) for name in LEAF]


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(manifest(table(spark, sf_dir, "documents"), LEAF, changed=tampered))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_token_counts,
        op2_license_scan,
        op3_decontamination,
        op4_token_store,
        op5_url_filter,
        op6_simhash_near_duplicates,
        op7_suffix_array_dedup,
        op8_quality_rules,
        op9_sentencepiece_codec,
        op10_language_id,
        op11_attention_quality,
        op12_token_alignment,
        op13_merkle_manifest,
    )
    return {query.__name__: query for query in named}


def statements() -> dict[str, str]:
    return {"op5_url_filter": URL_FILTER, "op13_merkle_manifest": MERKLE_MANIFEST}


URL_FILTER = r"""
with captures as (
  select page_id, url, 1704067200 + ('0x' || substr(md5(url || '@'), 1, 8))::bigint % 31536000 as moment,
    regexp_replace(regexp_replace(url, '^[^:/?#]+://', ''), '#.*$', '') as address,
    rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.') as host
  from pages
), hosts as (select distinct host as key from captures where host <> ''),
domains as (select distinct regexp_extract(key, '([^.]+\.[^.]+)$', 1) as key from hosts),
names as (
  select key, key || '#' || i as name, 3 as one_in from hosts, range(4) r(i)
  union all select key, key || '##' || i, 2 from domains, range(2) r(i)
), dated as (
  select key, max(('0x' || substr(md5(name || '!'), 1, 8))::bigint % 2 = 0) as listed,
    1704067200 + ('0x' || substr(md5(name), 1, 8))::bigint % 31536000 as since
  from names where ('0x' || substr(md5(name), 1, 8))::bigint % one_in <> 0
  group by key, since
), intervals as (
  select *, lead(since) over (partition by key order by since) as until from dated
), keys as (
  select distinct url, moment, address as key, 0 as rank from captures where host <> ''
  union all
  select distinct url, moment, array_to_string(list_slice(l, i, len(l)), '.'), i from (
    select url, moment, string_split(host, '.') as l, unnest(range(1, greatest(len(l) - 1, 1) + 1)) as i
    from captures where host <> '')
), decided as (
  select url, moment, arg_min(key, rank) as entry, arg_min(listed, rank) as listed,
    arg_min(i.since, rank) as since
  from keys join intervals i using (key)
  where i.since <= moment and (until is null or moment < until)
  group by url, moment
)
select page_id, c.url, c.moment as fetched_at, coalesce(listed, false) as blocked, entry, since
from captures c left join decided d on c.url = d.url and c.moment = d.moment
"""


def _sql_row_digest(n_chars: str) -> str:
    sized = {"n_chars": n_chars}
    texts = [f"({sized.get(c, c)})::varchar" for c in LEAF]
    return "sha256(" + " || ".join(
        f"coalesce(strlen({t})::varchar || ':' || {t}, '-')" for t in texts
    ) + ")"


#: CRC-32 of a short text, bit by bit, as DuckDB has no function for it.
_SQL_CRC = """xor(4294967295, list_reduce(list_concat([4294967295],
  list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b:
  list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"""

MERKLE_MANIFEST = f"""
with recursive rows_ as (
  select doc_id, coalesce('=' || lang, '-') as tree, {_sql_row_digest("n_chars")} as leaf,
    case when {_SQL_CRC} % 7 = 0 then {_sql_row_digest("n_chars::hugeint + 1")} end as changed
  from documents
), leaves as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as spot,
    count(*) over (partition by tree) as n
  from rows_
), low as (
  select 0 as level, tree, spot, leaf as node, n from leaves
  union all
  select level + 1, tree, spot // 2, sha256(string_agg(node, '' order by spot)), (n + 1) // 2
  from low where n > 1 group by level, tree, spot // 2, n
), subroots as (
  select tree, node, level, row_number() over (order by tree) - 1 as spot, count(*) over () as n
  from low where n = 1
), high as (
  select 0 as level, spot, node, n from subroots
  union all
  select level + 1, spot // 2, sha256(string_agg(node, '' order by spot)), (n + 1) // 2
  from high where n > 1 group by level, spot // 2, n
), steps as (
  select l.tree, l.spot, s.level, s.n, (l.spot >> s.level) % 2 as odd, o.node as other
  from leaves l
  join (select distinct level, tree, n from low where n > 1) s on s.tree = l.tree
  left join low o on o.tree = l.tree and o.level = s.level
    and o.spot = xor(l.spot >> s.level, 1::bigint)
  union all
  select l.tree, l.spot, r.level + h.level, h.n, (r.spot >> h.level) % 2, o.node
  from leaves l join subroots r on r.tree = l.tree
  cross join (select distinct level, n from high where n > 1) h
  left join high o on o.level = h.level and o.spot = xor(r.spot >> h.level, 1::bigint)
), proof as (
  select tree, spot, sha256(coalesce(string_agg(other, '' order by level), '')) as proof_sha256
  from steps group by tree, spot
), fold as (
  select tree, spot, 0 as level, coalesce(changed, leaf) as node from leaves
  union all
  select f.tree, f.spot, f.level + 1, sha256(case when s.other is null then f.node
    when s.odd = 1 then s.other || f.node else f.node || s.other end)
  from fold f join steps s on s.tree = f.tree and s.spot = f.spot and s.level = f.level
), ends as (
  select tree, spot, arg_max(node, level) as folded_root from fold group by tree, spot
)
select l.doc_id, l.leaf, r.node as subroot, (select node from high where n = 1) as root,
  coalesce(p.proof_sha256, sha256('')) as proof_sha256, e.folded_root,
  e.folded_root = (select node from high where n = 1) as verified
from leaves l join subroots r on r.tree = l.tree
left join proof p on p.tree = l.tree and p.spot = l.spot
join ends e on e.tree = l.tree and e.spot = l.spot
"""
