"""The queries op1 to op13: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import chat, jaccard, langid, mixing, ngram_lm, packing, periodic, repeats, rpforest, toxicity, url_filter, vptree, whitening
from graphmill.llm.common import WORD_PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vptree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vptree.search(rows, rows.where("vec_id % 50 = 0"), k=5, factor=1.0)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), jaccard.Params(width=4, num=85, den=100))


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.digest_chats(chat.format_chats(rows.unionByName(more)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document by crc32 goes on periodically from one of its words."""
    n = lambda w: F.size(w).cast("long")
    start = lambda w: F.col("g") % n(w)
    period = lambda w: 1 + F.floor((n(w) - start(w)) / (3 + F.col("g") % 8))

    def planted(w):
        """The numbers are bound to a struct first, so that they are worked out once a document."""
        numbers = F.array(F.struct(start(w).alias("a"), period(w).alias("p")))
        word = lambda k: F.transform(w, lambda x, i: F.when(i < k["a"], x).otherwise(F.get(w, (k["a"] + (i - k["a"]) % k["p"]).cast("int"))))
        return F.when(F.size(w) > 0, F.array_join(F.transform(numbers, word)[0], " ")).otherwise(F.lit(""))

    words = F.array(F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.coalesce(h % 10 == 0, F.lit(False)).alias("on"), F.floor(h / 10).alias("g"))
    return rows.select("doc_id", F.when(F.col("on") & F.col("text").isNotNull(), F.transform(words, planted)[0]).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    line = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"), F.sha2(line.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    done = ngram_lm.score_documents(table(spark, sf_dir, "documents"), held_out)
    six = lambda c: F.round(c, 6).alias(c)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", six("base_score"), six("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_vptree_search, op2_source_mixing, op3_ngram_jaccard, op4_chat_format, op5_toxicity, op6_embedding_dedup, op7_packing, op8_language_id, op9_suffix_dedup, op10_url_filter, op11_periodic_runs, op12_embedding_whitening, op13_lm_scoring)
    return {f.__name__: f for f in every}


OP2_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as r from d group by source),
c as (
  select source, source_size, [5.0::double, 2.0::double, 1.0::double][(r % 3) + 1] as w, source_size * 2.0::double as cap from s),
l as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over before, 0.0))
          / (sum(w) over () - coalesce(sum(w) over before, 0.0)) as level
  from c window before as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select level as final from l where cap / w >= level order by cap / w, source nulls last limit 1),
t as (
  select source, source_size, case when cap / w < (select final from f) then cap else coalesce(w * (select final from f), cap) end as target from l),
j as (
  select d.doc_id, d.size, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
         ('0x' || substr(md5(coalesce(d.doc_id::varchar, 'null') || ':17'), 1, 8))::bigint::double / 4294967296.0::double as u
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (floor(rate)::bigint + case when u < rate - floor(rate) then 1 else 0 end) * size as taken from j
"""

OP3_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
                                      else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from d),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (
  select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * i >= 85 * (x.n + y.n - i)),
r as (select a, b from l union select r.a, l.b from r join l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles,
       least(d.doc_id, coalesce((select min(b) from r where r.a = d.doc_id), d.doc_id)) as component_id,
       (select count(*) from l where l.a = d.doc_id)::bigint as n_links
from d left join n on n.doc_id = d.doc_id
"""

OP4_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r, text as t from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', 'x' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', 'x'),
e as (
  select *, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') as er, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as et from c)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r nulls first, t nulls first)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, r nulls first, t nulls first) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length(er) + length(et) + 23)::bigint as formatted_chars
from e group by conv_id
"""

OP6_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings),
u as (
  select vec_id, label, e from v
  where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
r as (select a, b from l union select r.a, l.b from r join l on l.a = r.b),
m as (select a, min(b) as b from r group by a),
k as (select a, count(*) as n from l group by a)
select v.vec_id, coalesce(k.n, 0)::bigint as n_links, least(v.vec_id, coalesce(m.b, v.vec_id)) as component_id,
       v.vec_id = least(v.vec_id, coalesce(m.b, v.vec_id)) as kept
from v left join m on m.a = v.vec_id left join k on k.a = v.vec_id
"""


#: Unsigned CRC-32 of a short ASCII text: bits of 0xEDB88320, a byte every eighth step.
CRC32_SQL = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, range(0, 8 * length({s}))), lambda c, k: case when (case when k % 8 = 0 then xor(c, ascii({s}[(k // 8 + 1)::int])::bigint) else c end) & 1 = 1 then xor((case when k % 8 = 0 then xor(c, ascii({s}[(k // 8 + 1)::int])::bigint) else c end) >> 1, 3988292384) else (case when k % 8 = 0 then xor(c, ascii({s}[(k // 8 + 1)::int])::bigint) else c end) >> 1 end))"

OP11_SQL = (
    r"""
with d as (
  select row_number() over () as r, doc_id, doc_id::varchar as s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
h as (
  select r, doc_id, w, len(w) as n, """
    + CRC32_SQL.format(s="s")
    + r""" as h from d),
g as (select *, h // 10 % n as a, 1 + (n - h // 10 % n) // (3 + h // 10 % 8) as p from h where n > 0),
v as (
  select r, case when h % 10 = 0 then list_transform(range(n), lambda i: case when i >= a then w[(a + (i - a) % p + 1)::int] else w[(i + 1)::int] end) else w end as w from g),
t as (select r, unnest(w) as word, generate_subscripts(w, 1) - 1 as i, len(w) as n from v),
f as (select * from t qualify count(*) over (partition by r, word) >= 4),
m as (select a.r, b.i - a.i as q, a.i from f a join f b on a.r = b.r and a.word = b.word and b.i > a.i and 4 * (b.i - a.i) <= a.n),
e as (select * from m qualify count(*) over (partition by r, q) >= greatest(6 - q, 3 * q)),
l as (select r, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by r, q order by i) as k from e) group by r, q, k having count(*) >= greatest(6 - q, 3 * q)),
u as (select r, start, length, min(q) as period from l group by 1, 2, 3),
x as (
  select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from u group by r),
b as (select * from u qualify row_number() over (partition by r order by length::decimal(38, 18) / period desc, start, period) = 1),
gone as (select distinct r, unnest(range(start + period, start + length)) as i from u),
kept as (select t.r, string_agg(word, ' ' order by i) as text from t left join gone using (r, i) where gone.r is null group by t.r)
select d.doc_id, coalesce(x.n_runs, 0)::bigint as n_runs, b.start::bigint as start, b.length::bigint as length, b.period::bigint as period, (1000 * b.length // b.period)::bigint as exponent_milli,
       sha256(coalesce(x.lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from d left join x using (r) left join b using (r) left join kept on kept.r = d.r
"""
)


def op13_sql() -> str:
    """Trigrams of words with ' ' for a text's start and '' for its end; one step an order for counts, contexts and discounts."""
    discount = lambda k, a, b: f"{k} - {k + 1} * y * {b} / {a}"
    steps = []
    for n, context in ((1, "1"), (2, "b"), (3, "a, b")):
        names = context if n > 1 else "1 as one"
        steps.append(f"s{n} as (select {names}, sum(n)::double as t, count(*) filter (n = 1) as o, count(*) filter (n = 2) as w, count(*) filter (n >= 3) as m from n{n}{' group by ' + context if n > 1 else ''})")
        steps.append(f"k{n} as (select count(*) filter (n = 1) as q1, count(*) filter (n = 2) as q2, count(*) filter (n = 3) as q3, count(*) filter (n = 4) as q4, q1 / (q1 + 2 * q2) as y, {discount(1, 'q1', 'q2')} as x1, {discount(2, 'q2', 'q3')} as x2, {discount(3, 'q3', 'q4')} as x3 from n{n})")
        good = "q1 > 0 and q2 > 0 and q3 > 0 and q4 > 0 and x1 > 0 and x1 < 1 and x2 > 0 and x2 < 2 and x3 > 0 and x3 < 3"
        steps.append(f"d{n} as (select {', '.join(f'case when {good} then x{k} else {ngram_lm.PLAIN_DISCOUNTS[k - 1]}::double end as d{k}' for k in (1, 2, 3))} from k{n})")
    p = "1::double / (v.words + 1)"
    for n in (1, 2, 3):
        own = f"coalesce(n{n}.n - case n{n}.n when 1 then d{n}.d1 when 2 then d{n}.d2 else d{n}.d3 end, 0.0)"
        p = f"case when s{n}.t > 0 then ({own} + (s{n}.o * d{n}.d1 + s{n}.w * d{n}.d2 + s{n}.m * d{n}.d3) * ({p})) / s{n}.t else ({p}) end"
    return rf"""
with d as (
  select row_number() over () as r, doc_id, doc_id::varchar as s, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
h as (select r, doc_id, {CRC32_SQL.format(s="s")} % 7 = 2 as held_out, list_concat([' ', ' '], w, ['']) as x from d),
g as (select r, held_out, x[i] as a, x[i + 1] as b, x[i + 2] as c from (select *, unnest(range(1, len(x) - 1)) as i from h)),
u as (select c, count(*) as n from g where not held_out group by c),
v as (select count(*) as words, coalesce(sum(n), 0)::bigint as tokens from u),
n3 as (select a, b, c, count(*) as n from g where not held_out group by all),
n2 as (select b, c, case when b = ' ' then sum(n) else count(*) end::bigint as n from n3 group by b, c),
n1 as (select c, count(*) as n from n2 group by c),
{", ".join(steps)},
p as (
  select g.r, log10(({p})) as p, u.c is not null as known, log10((coalesce(u.n, 0) + 1)::double / (v.tokens + v.words + 1)) as base
  from g cross join v cross join d1 cross join d2 cross join d3 cross join s1 left join u on u.c = g.c left join n1 on n1.c = g.c left join n2 on n2.b = g.b and n2.c = g.c
  left join n3 on n3.a = g.a and n3.b = g.b and n3.c = g.c left join s2 on s2.b = g.b left join s3 on s3.a = g.a and s3.b = g.b)
select h.doc_id, any_value(h.held_out) as held_out, count(*) as n_tokens, count(*) filter (p.known) as n_known, any_value(v.tokens) as train_tokens,
       round(sum(p.base), 6) as base_score, round(sum(p.p), 6) as score
from h join p using (r) cross join v group by r, h.doc_id
"""


def op10_sql() -> str:
    """Host and path by pattern, rules by length; terms by one pattern of all spellings, the longest first, between word boundaries.

    An underscore is no word character here but is one for ``\\b``, so it is read as a hyphen.
    """
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [f"(host = '{d}' or ends_with(host, '.{d}')) and starts_with(path, '{p}')" for _, d, p in rules]
    name = "case " + " ".join(f"when {f} then '{d}{p}'" for f, (_, d, p) in zip(fits, rules, strict=True)) + " end"
    said = "case " + " ".join(f"when {f} then '{k}'" for f, (k, _, _) in zip(fits, rules, strict=True)) + " end"
    weights = url_filter.read_vocabulary()
    spelt = {s.replace("_", "-"): t for s, t in url_filter.spellings(weights).items()}
    terms = ", ".join(f"('{s}', '{t}', {weights[t]})" for s, t in spelt.items())
    pattern = "|".join(s.replace(".", "[.]").replace("+", "[+]") for s in sorted(spelt, key=lambda s: (-len(s), s)))
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
with v(spelling, term, weight) as (values {terms}),
p as (
  select page_id, row_number() over () as row, translate(coalesce(url, ''), {lower}) as low, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) as rest from pages),
h as (
  select page_id, row, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), {lower}) as host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from p),
w as (select row, unnest(regexp_extract_all(replace(low, '_', '-'), '\\b(?:{pattern})\\b')) as spelling from p),
t as (select row, sum(weight) as weight from (select distinct row, term, weight::double as weight from w join v using (spelling)) group by row)
select page_id, host, path, {name} as rule,
       coalesce({said}, case when coalesce(weight, 0) >= {url_filter.LIMIT} then 'block' else 'allow' end) as verdict
from h left join t using (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": OP2_SQL, "op3_ngram_jaccard": OP3_SQL, "op4_chat_format": OP4_SQL, "op6_embedding_dedup": OP6_SQL, "op10_url_filter": op10_sql(), "op11_periodic_runs": OP11_SQL, "op13_lm_scoring": op13_sql()}
