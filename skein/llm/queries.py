"""The registered queries of this subpackage, with their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import alignment, langid, licenses, linededup, mixing, phrases, quality, sentencepieces, simhash, syncmers, tokenfiles, topk, toxicity
from skein.llm.common import ready
from skein.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: read_table(ready(spark), sf_dir, table))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_langid")
def op1_langid(table) -> DataFrame:
    return langid.identify(table("documents"))


@query("op2_token_file")
def op2_token_file(table) -> DataFrame:
    import public_tokenizers

    return tokenfiles.round_trip(table("documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_quality")
def op3_quality(table) -> DataFrame:
    return quality.classify(table("documents"), table("labels"))


@query("op4_line_dedup")
def op4_line_dedup(table) -> DataFrame:
    return linededup.duplicate_lines(table("documents")).withColumn("n_dropped", F.size("dropped").cast("long"))


@query("op5_syncmers")
def op5_syncmers(table) -> DataFrame:
    return syncmers.edited_fingerprints(table("documents"))


#: The same mix, with all quotients listed instead of those in reach.
OP6_SQL = r"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    coalesce('0' || source, '1') as k, md5(concat_ws(':', 'mix-1', doc_id::varchar)) as h
  from documents
), weighed as (
  select k, sum(size)::double as source_size, ([3.0, 1.0, 2.0])[((row_number() over (order by k) - 1) % 3 + 1)::integer]::double as w
  from docs group by k
), levelled as (
  select *, 2 * source_size as cap,
    (sum(source_size) over () * 1.5 - coalesce(sum(2 * source_size) over (order by 2 * source_size / w, k rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by 2 * source_size / w, k rows between current row and unbounded following) as level
  from weighed
), targets as (
  select k, source_size, least(cap, coalesce((select min_by(level, cap / w) from levelled where level <= cap / w), 0) * w) as target from levelled
), seats as (select round(sum(target) / 8)::bigint as n from targets),
won as (
  select k, count(*) as blocks from (
    select k, row_number() over (order by target / (2 * j + 1) desc, target desc, k, j) as place
    from (select k, target, unnest(range(0, ceil(target / 8)::bigint + (select count(*) from targets) + 2)) as j from targets where target > 0)
  ) where place <= (select n from seats) group by k
), source_blocks as (
  select k, source_size, target, coalesce(blocks, 0) as blocks, greatest(1, ceil(source_size / 1000000))::bigint as shards
  from targets left join won using (k)
), placed as (
  select d.*, source_size, target, blocks, ('0x' || substr(h, 9, 8))::ubigint::bigint % shards as shard from docs d join source_blocks using (k)
), sized as (
  select k, shard, any_value(blocks) as blocks, sum(size)::bigint as shard_size from placed group by k, shard
), shard_won as (
  select k, shard, count(*) as quota from (
    select k, shard, blocks, row_number() over (partition by k order by shard_size / (2 * j + 1) desc, shard_size desc, k, shard, j) as place
    from (select *, unnest(range(0, ceil(blocks * shard_size / source_words)::bigint + shards + 3)) as j from (
      select z.*, b.shards, b.source_size as source_words from sized z join source_blocks b using (k)) where shard_size > 0)
  ) where place <= blocks group by k, shard
), quotas as (
  select k, shard, ceil(shard_size / 8)::bigint as len, least(coalesce(quota, 0), 2 * ceil(shard_size / 8)::bigint) as quota,
    ('0x' || substr(md5('mix-1:' || k || ':' || shard), 1, 8))::ubigint::bigint % greatest(1, ceil(shard_size / 8)::bigint) as start
  from sized left join shard_won using (k, shard)
), lined as (
  select p.*, len, start, case when len > 0 then quota // len else 0 end as laps, case when len > 0 then quota % len else 0 end as rest,
    coalesce(sum(size) over (partition by k, shard order by h, size rows between unbounded preceding and 1 preceding), 0) as a
  from placed p join quotas using (k, shard)
)
select doc_id, source, size::bigint as size, source_size::bigint as source_size, target,
  (laps * size + greatest(0, least(a + size, least(start + rest, len) * 8) - greatest(a, start * 8))
    + greatest(0, least(a + size, (start + rest - len) * 8) - greatest(a, 0)))::bigint as taken
from lined
"""


@query("op6_mixing", OP6_SQL)
def op6_mixing(table) -> DataFrame:
    return mixing.mix(table("documents"))


@query("op7_simhash")
def op7_simhash(table) -> DataFrame:
    return simhash.near_duplicates(table("documents"))


def piece_model() -> str:
    """The SentencePiece model the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op9_sentencepiece")
def op9_sentencepiece(table) -> DataFrame:
    return sentencepieces.report(table("documents"), piece_model())


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as cells from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.cells, c.cells), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on c.vec_id <> q.vec_id and len(q.cells) = len(c.cells)
  where q.vec_id % 20 = 0
)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 20
"""


@query("op8_top_k", OP8_SQL)
def op8_top_k(table) -> DataFrame:
    return topk.top_k(table("embeddings"), F.col("vec_id") % 20 == 0, 20)


def _op10_sql() -> str:
    """Every block of 64 words against every notice that the whole text could hold."""
    listed = ", ".join(f"({i}, '{label}', list_distinct(string_split('{n}', ' ')))" for i, (label, n) in enumerate(licenses.NOTICES))
    phrases = ", ".join(f"('{label}', string_split('{p}', ' '))" for p, label in licenses.PHRASES)
    return f"""
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), phrase(label, p) as (values {phrases}), notice(n, label, t) as (values {listed}),
place as (
  select r, label, i - 1 as i from (select r, w, label, p, unnest(range(1, len(w) - len(p) + 2)) as i from d, phrase
    where list_has_all(w, p))
  where w[i : i + len(p) - 1] = p
), base as (
  select r, count(*) as n_base, min(i) as first_word, max(i) as last_word, list(distinct label) as labels from place group by r
), may as (
  select r, w, label, t from d, notice where len(list_intersect(t, w)) * 1000 >= 800 * len(t)
), block as (
  select r, label, t, w[i + 1 : i + 64] as b from (select *, unnest(range(0, len(w))) as i from may)
), held as (
  select r, label, len(list_intersect(t, b)) / len(t) as held from block
  where len(list_intersect(t, b)) * 1000 >= 800 * len(t)
), more as (
  select r, max(held) as held, list(distinct label) as labels from held group by r
)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, more.labels))), ','), '') as labels,
  case when n_base > 0 then 1.0 else coalesce(held, 0) end::double as score
from d left join base using (r) left join more using (r)
"""


@query("op10_licenses", _op10_sql())
def op10_licenses(table) -> DataFrame:
    return licenses.scan(table("documents"))


@query("op11_token_alignment")
def op11_token_alignment(table) -> DataFrame:
    import public_tokenizers

    return alignment.align_texts(table("documents"), public_tokenizers.path("byte_bpe_50k.json"), piece_model())


#: All n-grams counted, without summaries.
OP12_SQL = r"""
with pieces as (
  select row_number() over () as p, lang, piece from (
    select coalesce(lang, 'und') as lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents)
), cut as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
mass as (select lang, sum(len(w))::bigint as n from cut group by lang),
grams as (
  select lang, g, count(*) as f from (
    select lang, unnest(list_transform(range(1, len(w) - size + 2), lambda i: w[i : i + size - 1])) as g
    from cut, (select unnest(range(1, 6)) as size) where len(w) >= size)
  group by lang, g having count(*) >= 100
), candidate as (select lang, g, f as a from grams where len(g) > 1),
cuts as (
  select c.lang, c.g, c.a, k, l.f as l, r.f as r, n, (1000::hugeint * c.a * n) // (l.f::hugeint * r.f) as score
  from (select *, unnest(range(1, len(g))) as k from candidate) c join mass m on c.lang = m.lang
    join grams l on l.lang = c.lang and l.g = c.g[1 : k] join grams r on r.lang = c.lang and r.g = c.g[k + 1 :]
), best as (
  select * from (select *, row_number() over (partition by lang, g order by score, k) as place from cuts) where place = 1
), inner_part as (
  select lang, part, max(a) as longer from (
    select lang, a, unnest(flatten(list_transform(range(2, len(g)), lambda size: list_transform(range(1, len(g) - size + 2), lambda i: g[i : i + size - 1])))) as part
    from candidate where len(g) > 2)
  group by lang, part
), kept as (
  select b.*, array_to_string(g, ' ') as phrase from best b left join inner_part i on i.lang = b.lang and i.part = b.g
  where longer is null or 100 * longer < 100 * a
)
select lang, rank, phrase, a, l, r, n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12_collocations(table) -> DataFrame:
    return phrases.collocations(table("documents"))


@query("op13_toxicity")
def op13_toxicity(table) -> DataFrame:
    return toxicity.classify(table("documents"), table("labels"))
