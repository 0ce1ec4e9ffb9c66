"""The registered queries over whole tables, and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headlight.functions import text as T
from headlight.functions import urls as U
from headlight.functions.lexicons import BAIT, BOILERPLATE, CUES, DECEPTION, HOOKS, NEGATIVE, NOISE, POSITIVE, SIGNALS, STOPWORDS, TEASERS
from headlight.operators import enrich, lexical, semantic, traffic
from headlight.plans import cases, report, workers
from headlight.sources import html
from headlight.sources.html import articles

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = workers.query(f)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


#: Bytes of a table for each core up to which its rows are spread; larger tables have row groups for all cores.
SPREAD = 16 << 20


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def read_texts(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows cost much: a small one, which may be a single row group, is spread over all cores first."""
    df, cores = read(spark, sf, name), spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    df = df.select(*columns)
    return df.repartition(3 * cores) if size < SPREAD * cores else df


TEMPLATES = {
    1: "You won't believe this SHOCKING secret", 2: "Top 10 miracle cure proof!!!", 3: "Is this the truth about hate?", 4: "GUARANTEED INSTANTLY EXPOSED", 5: "Best 5 benefits win hope",
    6: "Number 7 what happened next??", 7: "", 8: "Scam fraud warning crisis", 10: "Incredible must see 100% hoax",
}
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def headlines(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, lang, raw (the first line), title (templated by id, so that every signal occurs) and body (the rest)."""
    d = read_texts(spark, sf, "documents", "doc_id", "lang", "text").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("raw", F.substring_index("text", "\n", 1)).withColumn("body", F.expr("substring(text, length(raw) + 2)"))
    title, k = F.col("raw"), F.col("doc_id") % 12
    title = F.when(k == 9, F.concat("raw", F.lit("!"))).when(k == 11, F.translate("raw", LOWER, UPPER)).otherwise(title)
    for i, t in TEMPLATES.items():
        title = F.when(k == i, F.lit(t)).otherwise(title)
    return d.withColumn("title", title).drop("text")


# ---- SQL pieces -----------------------------------------------------------------------------------------------------

WS = r"'[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+'"
q = lambda s: "'" + s.replace("'", "''") + "'"
sql_list = lambda xs: "[" + ", ".join(map(q, xs)) + "]"
norm = lambda x: f"trim(regexp_replace(coalesce({x}, ''), {WS}, ' ', 'g'))"
toks = lambda x: f"list_filter(string_split(regexp_replace(lower({norm(x)}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"
count = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
content = lambda x: f"list_filter({x}, lambda t: not list_contains({sql_list(STOPWORDS)}, t))"
HEAD = f"""h0 as (select doc_id, lang, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10))[1] as raw from documents),
h as (select doc_id, lang, raw, substr(text, length(raw) + 2) as body, case doc_id % 12 {' '.join(f'when {k} then {q(v)}' for k, v in TEMPLATES.items())}
  when 9 then raw || '!' when 11 then translate(raw, '{LOWER}', '{UPPER}') else raw end as title from h0)"""
PREP = f"""p0 as (select *, {norm('title')} as t_norm from h),
p1 as (select *, lower(t_norm) as t_low, lower(body) as b_low, {toks('t_norm')} as t_tok, {toks('body')} as b_tok from p0),
p as (select *, list_distinct({content('t_tok')}) as t_set, list_distinct({content('b_tok')}) as b_set from p1)"""
SIM = "case when len(t_set) = 0 or len(b_set) = 0 then 0.0::double else len(list_intersect(t_set, b_set))::double / len(t_set) end"
n_in = lambda xs: f"len(list_filter(t_tok, lambda t: list_contains({sql_list(xs)}, t)))"
POL = f"(({n_in(POSITIVE)} - {n_in(NEGATIVE)})::double / greatest(1, {n_in(POSITIVE)} + {n_in(NEGATIVE)}))"
hit = lambda p: f"regexp_matches(t_low, {q(p)})"
total = lambda ps: "(" + " + ".join(f"{hit(p)}::int" for p, _ in ps) + ")"
BANG, ASK = f"least(12, 4 * {count('t_norm', '!')})", f"least(10, 4 * {count('t_norm', '[?]')})"
UP = f"(case when {count('t_norm', '[A-Za-z]')} = 0 then 0.0 else {count('t_norm', '[A-Z]')}::double / {count('t_norm', '[A-Za-z]')} end > 0.45 and length(t_norm) > 16)"
LEN = "(len(list_filter(string_split(t_norm, ' '), lambda w: w <> '')) < 4 or len(list_filter(string_split(t_norm, ' '), lambda w: w <> '')) > 20)"
in_b = lambda c, w: rf"regexp_matches({c}, '\b{w}\b')"
TEASE = f"(length(body) > 200 and ({' or '.join(in_b('t_low', w) for w in TEASERS)}) and not ({' or '.join('(' + in_b('t_low', w) + ' and ' + in_b('b_low', w) + ')' for w in TEASERS)}))"
SCORE = f"""s0 as (select *, {SIM} as sim, {POL} as pol, {total(BAIT)} * 14 + {total(DECEPTION)} * 10 + {BANG} + {ASK} + 10 * {UP}::int + 6 * {LEN}::int as hook, {TEASE} as tease from p),
s1 as (select *, 18 * (sim < 0.35)::int + 12 * tease::int as gap, 12 * (abs(pol) > 0.5)::int as senti from s0),
s2 as (select *, 6 * (gap > 0 and hook > 0)::int as syn, t_norm = '' as none from s1),
s as (select doc_id, lang, title, none, case when none then 65 else greatest(0, least(100, hook + gap + senti + syn)) end as score, case when none then 20 else gap end as gap_points,
  case when none then 0 else senti end as sentiment_points, case when none then 45 else hook end as hook_points, case when none then 0 else syn end as synergy_points,
  case when none then 0.0 else sim end as similarity, case when none then 0.0 else pol end as polarity, hook, gap, tease, sim, pol, syn, t_low, t_norm from s2)"""
VERDICT = "case when score >= 70 then 'Clickbait' when score >= 40 then 'Borderline' else 'Likely Legit' end"
ALL = f"with {HEAD}, {PREP}, {SCORE}"
TEXT = "coalesce(text, '')"


# ---- text scalars -----------------------------------------------------------------------------------------------------


def _docs(spark: SparkSession, sf: str, **cols: Column) -> DataFrame:
    d = read_texts(spark, sf, "documents", "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", *[c.alias(k) for k, c in cols.items()])


@query(f"select doc_id, {norm('text')} as norm from documents")
def normalize_ws(spark, sf):
    return _docs(spark, sf, norm=T.normalize_space(F.col("text")))


@query(f"select doc_id, len({toks('text')}) as n_tokens, len(list_distinct({toks('text')})) as n_distinct from documents")
def token_counts(spark, sf):
    return _docs(spark, sf, toks=T.tokens(F.col("text"))).select("doc_id", F.size("toks").alias("n_tokens"), F.size(F.array_distinct("toks")).alias("n_distinct"))


@query(f"select doc_id, len({content(toks('text'))}) as n_content, len(list_distinct({content(toks('text'))})) as n_content_distinct from documents")
def stopword_filtered_counts(spark, sf):
    d = _docs(spark, sf, toks=T.tokens(F.col("text")))
    return d.select("doc_id", F.size(T.content_bag(F.col("toks"))).alias("n_content"), F.size(T.content_set(F.col("toks"))).alias("n_content_distinct"))


@query(rf"""select doc_id, {count(TEXT, r'\b\d+(?:\.\d+)?%?\b')} as claims, {count("coalesce(string_split(text, chr(10))[1], '') || ' ' || substr(substr(coalesce(text, ''), length(coalesce(string_split(text, chr(10))[1], '')) + 2), 1, 1800)", r'\b\d+(?:[.,]\d+)?\b')} as claims_both from documents""")
def numeric_claims(spark, sf):
    d = _docs(spark, sf, text=F.col("text"), head=F.substring_index("text", "\n", 1))
    return d.select("doc_id", T.numeric_claims(F.col("text")).alias("claims"), T.numeric_claims_both(F.col("head"), F.expr("substring(text, length(head) + 2)")).alias("claims_both"))


@query(f"""select doc_id, greatest(1, round(len({toks('text')}) / 220.0)::int) as minutes, greatest(1, round_even(len({toks('text')}) / 220.0, 0)::int) as minutes_even,
  case when substr({norm('text')}, 1, 300) = '' then 'Body text was unavailable.' else substr({norm('text')}, 1, 300) end as snippet, replace(replace(replace(replace({TEXT}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as escaped from documents""")
def read_time_and_snippet(spark, sf):
    n = F.size(T.tokens(F.col("text")))
    return _docs(spark, sf, minutes=T.read_minutes(n), minutes_even=T.read_minutes(n, even=True), snippet=T.snippet(F.col("text")), escaped=T.escape_html(F.col("text")))


SAN = rf"""trim(regexp_replace(regexp_replace({norm('x')}, '[{{}}\[\]"]+', ' ', 'g'), {WS}, ' ', 'g'))"""
NOISY = rf"""(x = '' or {' + '.join(f"contains(lower(x), '{m}')::int" for m in NOISE)} >= 2 or {count('x', '[{}\\[\\]"=:;,_]')}::double / greatest(1, length(x)) > 0.12 or {count('x', '[A-Za-z]')}::double / greatest(1, length(x)) < 0.45)"""
LINES = f"with l0 as (select doc_id, unnest(string_split({TEXT}, chr(10))) as x from documents), l as (select doc_id, {SAN} as x from l0)"


@query(f"""{LINES} select doc_id, count(*) as n_lines, sum({NOISY}::int)::bigint as n_noisy, sum((length(x) >= 60 and not {NOISY} and not regexp_matches(lower(x), '{BOILERPLATE}') and len(string_split(x, ' ')) >= 10
  and len(list_filter(string_split(x, ' '), lambda w: length(w) > 20)) <= 2)::int)::bigint as n_readable from l group by doc_id""")
def noise_and_readable_lines(spark, sf):
    d = read_texts(spark, sf, "documents", "doc_id", "text").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("x")).select("doc_id", T.sanitize(F.col("x")).alias("x"))
    x = F.col("x")
    return d.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(T.is_noisy(x).cast("int")).alias("n_noisy"), F.sum(T.is_readable(x).cast("int")).alias("n_readable"))


# ---- lexical scoring ----------------------------------------------------------------------------------------------------


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.prepare(headlines(spark, sf))


@query(f"with {HEAD}, {PREP} select doc_id, {SIM} as similarity from p")
def lexical_similarity(spark, sf):
    return _prepared(spark, sf).select("doc_id", lexical.similarity().alias("similarity"))


@query(f"with {HEAD}, {PREP} select doc_id, {SIM} as similarity from p")
def lexical_similarity_join(spark, sf):
    return lexical.similarity_join(headlines(spark, sf), "doc_id")


@query(f"with {HEAD}, {PREP} select doc_id, {POL} as polarity, abs({POL}) > 0.5 as tone from p")
def headline_sentiment(spark, sf):
    return _prepared(spark, sf).select("doc_id", lexical.polarity().alias("polarity"), (F.abs(lexical.polarity()) > 0.5).alias("tone"))


@query(f"with {HEAD}, {PREP} select doc_id, {total(BAIT)} as bait, {total(DECEPTION)} as deception from p")
def pattern_hits(spark, sf):
    return _prepared(spark, sf).select("doc_id", lexical.hit_count(BAIT).alias("bait"), lexical.hit_count(DECEPTION).alias("deception"))


@query(f"with {HEAD}, {PREP}, d(pattern) as (values {', '.join(f'({q(p)})' for p, _ in BAIT + DECEPTION)}) select pattern, count(*) as n from p join d on regexp_matches(t_low, pattern) group by pattern")
def pattern_theta_join(spark, sf):
    """A theta join with the fixed table of 25 patterns, which is why it is broadcast."""
    dim = spark.createDataFrame([(p, T.ascii_edges(p)) for p, _ in BAIT + DECEPTION], "pattern string, java string")
    return _prepared(spark, sf).select("t_low").join(F.broadcast(dim), F.expr("t_low rlike java")).groupBy("pattern").agg(F.count("*").alias("n"))


@query(f"with {HEAD}, {PREP} select doc_id, {BANG} as bang, {ASK} as ask, {UP} as upper_hit, {LEN} as length_hit, {TEASE} as teaser_hit from p")
def headline_points(spark, sf):
    return _prepared(spark, sf).select("doc_id", lexical.bang_points().alias("bang"), lexical.ask_points().alias("ask"), lexical.upper_hit().alias("upper_hit"), lexical.length_hit().alias("length_hit"), lexical.teaser_hit().alias("teaser_hit"))


@query(f"""{ALL} select doc_id, score, {VERDICT} as verdict, case when score >= 70 then 'risky' when score >= 40 then 'warning' else 'safe' end as bucket, 100 - score as confidence,
  gap_points, sentiment_points, hook_points, synergy_points, similarity, polarity from s""")
def lexical_score(spark, sf):
    cols = "score verdict bucket confidence gap_points sentiment_points hook_points synergy_points similarity polarity".split()
    return lexical.score(headlines(spark, sf)).select("doc_id", *cols)


SIGNAL_SQL = ", ".join(
    [f"case when {hit(p)} then {q(SIGNALS['bait'] % x)} end" for p, x in BAIT] + [f"case when {hit(p)} then {q(SIGNALS['deception'] % x)} end" for p, x in DECEPTION]
    + [f"case when {c} then {q(SIGNALS[k])} end" for c, k in ((f"{BANG} > 0", "bang"), (f"{ASK} > 0", "ask"), (UP, "upper"), (LEN, "length"), ("sim < 0.35", "gap"), ("abs(pol) > 0.5", "tone"), ("tease", "teaser"), ("syn > 0", "synergy"))]
)


@query(f"{ALL} select doc_id, array_to_string(case when none then [{q(SIGNALS['none'])}] else list_filter([{SIGNAL_SQL}], lambda x: x is not null)[1:6] end, ' | ') as signals from s")
def lexical_signals(spark, sf):
    return lexical.score(headlines(spark, sf)).select("doc_id", F.array_join("signals", " | ").alias("signals"))


@query(f"{ALL} select lang, {VERDICT} as verdict, count(*) as n, sum(score)::bigint as total from s group by all")
def verdict_by_language(spark, sf):
    return lexical.score(headlines(spark, sf)).groupBy("lang", "verdict").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query(f"{ALL} select lang, v as verdict, count(*) as n from (select lang, {VERDICT} as v from s) group by rollup(lang, v)")
def verdict_rollup(spark, sf):
    return lexical.score(headlines(spark, sf)).rollup("lang", "verdict").agg(F.count("*").alias("n"))


@query(f"{ALL} select {VERDICT} as verdict, quality, count(*) as n from s join labels using (doc_id) group by all")
def label_confusion(spark, sf):
    d = lexical.score(headlines(spark, sf)).select("doc_id", "verdict")
    return d.join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id").groupBy("verdict", "quality").agg(F.count("*").alias("n"))


BARS = ["gap_points", "sentiment_points", "hook_points", "synergy_points"]


@query(f"{ALL} select doc_id, {', '.join(f'{b}::double / greatest(1, {chr(44).join(BARS)}) * 100 as {b}_pct' for b in BARS)} from s")
def breakdown_bars(spark, sf):
    return lexical.score(headlines(spark, sf)).select("doc_id", *report.breakdown_bars(BARS))


# ---- enrichment ---------------------------------------------------------------------------------------------------------


@query(f"""with t as (select doc_id, {toks('text')} as w from documents), e as (select doc_id, unnest(w) as tok, generate_subscripts(w, 1) as pos from t),
c as (select doc_id, tok, count(*) as n, min(pos) as f from e where length(tok) > 3 and not list_contains({sql_list(STOPWORDS)}, tok) group by all),
r as (select *, row_number() over (partition by doc_id order by n desc, f) as r from c)
select d.doc_id, coalesce(k.s, '') as key_phrases from documents d left join (select doc_id, string_agg(tok, ' ' order by r) as s from r where r <= 8 group by doc_id) k using (doc_id)""")
def key_phrases(spark, sf):
    return read_texts(spark, sf, "documents", "doc_id", "text").select("doc_id", F.array_join(enrich.key_phrases(F.col("text")), " ").alias("key_phrases"))


@query(f"""with t as (select doc_id, {toks("substr(text, 1, 6000)")} as w from documents), e as (select doc_id, unnest(w) as tok, generate_subscripts(w, 1) as pos from t),
c as (select doc_id, tok, count(*) as n, min(pos) as f from e where length(tok) > 3 and regexp_full_match(tok, '[a-z]+') and not list_contains({sql_list(STOPWORDS)}, tok) group by all),
r as (select *, row_number() over (partition by doc_id order by n desc, f) as r from c)
select d.doc_id, coalesce(k.s, '') as key_phrases from documents d left join (select doc_id, string_agg(tok, ' ' order by r) as s from r where r <= 8 group by doc_id) k using (doc_id)""")
def body_phrases(spark, sf):
    return read_texts(spark, sf, "documents", "doc_id", "text").select("doc_id", F.array_join(enrich.body_phrases(F.col("text")), " ").alias("key_phrases"))


@query(rf"""with {HEAD}, e as (select doc_id, list_transform(regexp_extract_all(raw || '. ' || substr(body, 1, 2200), '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}})\b'), lambda x: {norm('x')}) as xs from h),
f as (select doc_id, list_filter(xs, lambda x: length(x) > 2 and not regexp_matches(x, '^The$|This$|That$|And$|But$')) as xs from e),
u as (select doc_id, unnest(xs) as x, generate_subscripts(xs, 1) as pos from f), g as (select doc_id, x, min(pos) as pos from u group by all), r as (select *, row_number() over (partition by doc_id order by pos) as r from g)
select h.doc_id, coalesce(k.s, '') as nouns from h left join (select doc_id, string_agg(x, ' | ' order by r) as s from r where r <= 12 group by doc_id) k using (doc_id)""")
def proper_nouns(spark, sf):
    return headlines(spark, sf).select("doc_id", F.array_join(enrich.proper_nouns(F.col("raw"), F.col("body")), " | ").alias("nouns"))


SENT = rf"list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {norm('x')}), lambda x: length(x) > 30)"


@query(f"""with {HEAD}, g as (select doc_id, list_filter({SENT}, lambda x: not {NOISY}) as good from h), c as (select *, list_filter(good, lambda x: regexp_matches(lower(x), '{CUES}')) as cued from g)
select doc_id, array_to_string((case when len(cued) > 0 then cued else good end)[1:4], ' | ') as sentences from c""")
def supporting_sentences(spark, sf):
    return headlines(spark, sf).select("doc_id", F.array_join(enrich.supporting_sentences(F.col("body")), " | ").alias("sentences"))


@query(f"""with {HEAD}, {PREP}, g as (select doc_id, t_set, list_filter(list_transform(string_split(regexp_replace(substr(body, 1, 5000), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {norm('x')}), lambda x: length(x) >= 30) as ss from p),
e as (select doc_id, t_set, unnest(ss) as x, generate_subscripts(ss, 1) as pos from g), f as (select doc_id, x as sentence, pos, len(list_intersect(t_set, list_distinct({content(toks('x'))}))) + least(2.0::double, length(x)::double / 160) as points from e)
select doc_id, sentence, points from f qualify row_number() over (partition by doc_id order by points desc, pos) <= 3""")
def overlap_sentences(spark, sf):
    return enrich.overlap_sentences(headlines(spark, sf), "doc_id", "title", "body").drop("pos")


# ---- semantic scoring -----------------------------------------------------------------------------------------------------

EMB = lambda name, src: f"""{name}0 as (select doc_id, unnest({content(toks(src))}) as tok from h), {name}1 as (select doc_id, ('0x' || substr(sha256(tok), 1, 8))::bigint % 384 as dim, sum(1000 + ('0x' || substr(sha256(tok), 9, 8))::bigint % 1000)::double / 1000 as w from {name}0 group by all),
{name} as (select doc_id, dim, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from {name}1)"""  # noqa: E731
COS = f"{EMB('a', 'title')}, {EMB('b', 'substr(body, 1, 6000)')}, dot as (select a.doc_id, sum(a.weight * b.weight) as dot from a join b using (doc_id, dim) group by all), cos as (select h.doc_id, round(greatest(-1.0, least(1.0, coalesce(dot, 0.0))), 6) as cosine from h left join dot using (doc_id))"


@query(f"with {HEAD}, {EMB('a', 'title')} select doc_id, dim, round(weight, 6) as weight from a")
def hash_embedding(spark, sf):
    return semantic.hash_embedding(headlines(spark, sf), "doc_id", "title").select("doc_id", "dim", F.round("weight", 6).alias("weight"))


@query(f"with {HEAD}, {COS} select doc_id, cosine from cos")
def hash_cosine(spark, sf):
    return headlines(spark, sf).select("doc_id", semantic.hash_cosine(F.col("title"), F.col("body")).alias("cosine"))


@query("select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def vector_cosine(spark, sf):
    e = read(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(semantic.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


HOOK = "least(35, 12 * (" + " + ".join(f"regexp_matches(lower(title), {q(p)})::int" for p, _ in HOOKS) + ")) / 100.0::double"


SEMANTIC = f"""x as (select doc_id, title, cosine as sim, {POL} as pol, {HOOK} as hook from p join cos using (doc_id)),
y as (select *, case when sim < 0.35 then least(1.0, (0.35::double - sim) / 0.35::double) else 0.0 end * 58 as gap_part, least(1.0, abs(pol)) * 28 as sentiment_part, hook * 40 as hook_part, case when sim < 0.35 and abs(pol) > 0.5 then 8.0 else 0.0 end as synergy_part from x),
z0 as (select *, greatest(0, least(100, round_even(gap_part + sentiment_part + hook_part + synergy_part, 0)::int)) as score from y),
z as (select *, case when sim < 0.35 and abs(pol) > 0.5 and score >= 65 then 'Clickbait' when abs(pol) > 0.5 and score >= 45 then 'Sensationalist' when score >= 35 or sim < 0.35 then 'Borderline' else 'Legitimate' end as verdict from z0)"""
SEM_SUMMARY = """case verdict when 'Clickbait' then 'High risk of clickbait/deceptive framing (score ' when 'Sensationalist' then 'Headline appears emotionally exaggerated (score '
  when 'Borderline' then 'Mixed signals detected. Review article context carefully (score ' else 'Headline/body alignment appears mostly legitimate (score ' end || score || '/100).'"""
SUMMARY = """case when score >= 70 then 'This article headline shows strong clickbait/deceptive signals.' when score >= 40 then 'This article has some clickbait characteristics. Read carefully before trusting the framing.'
  else 'This headline appears relatively neutral with limited clickbait signals.' end"""
BUCKET = "case when verdict = 'Clickbait' then 'risky' when verdict in ('Sensationalist', 'Borderline') then 'warning' else 'safe' end"
HOOK_SQL = ", ".join(f"case when regexp_matches(lower(title), {q(p)}) then {q(x)} end" for p, x in HOOKS)


@query(f"with {HEAD}, {PREP}, {COS}, {SEMANTIC} select doc_id, score, verdict from z")
def semantic_composite(spark, sf):
    return report.score_semantic(headlines(spark, sf)).select("doc_id", "score", "verdict")


@query(f"""with {HEAD}, {PREP}, {COS}, {SEMANTIC} select doc_id, {SEM_SUMMARY} as summary, round_even(gap_part, 1) as gap_part, round_even(sentiment_part, 1) as sentiment_part, round_even(hook_part, 1) as hook_part, synergy_part::double as synergy_part,
  array_to_string(list_filter([case when sim < 0.35 then printf('Semantic gap detected: cosine similarity %.3f is below 0.35.', sim) end, case when abs(pol) > 0.5 then printf('Strong headline sentiment: polarity %.3f exceeds +/-0.50.', pol) end, {HOOK_SQL}], lambda x: x is not null)[1:8], ' | ') as signals from z""")
def semantic_report(spark, sf):
    d = report.score_semantic(headlines(spark, sf))
    return d.select("doc_id", "summary", "gap_part", "sentiment_part", "hook_part", "synergy_part", F.array_join("signals", " | ").alias("signals"))


@query(f"""{ALL}, {COS}, {SEMANTIC}, u as (select doc_id, 'node-heuristic' as engine, score, {VERDICT} as verdict, {SUMMARY} as summary from s union all select doc_id, 'python-nlp (hash)', score, verdict, {SEM_SUMMARY} from z)
select *, {BUCKET} as bucket from u""")
def engine_union(spark, sf):
    return report.union_engines(headlines(spark, sf), "doc_id").drop("signals")


@query(f"{ALL} select doc_id, {SUMMARY} as summary from s")
def score_summary(spark, sf):
    return lexical.score(headlines(spark, sf)).select("doc_id", "summary")


places = lambda x: f"round(printf('%.30f', {x})::decimal(38, 30), 3)::decimal(20, 3)::varchar"


@query(f"{ALL} select doc_id, {places('similarity')} as similarity, {places('polarity')} as polarity, case when similarity < 0.35 or none then 'Yes' else 'No' end as semantic_gap, round(2 * pi() * 52 * (1 - score / 100.0::double), 6) as gauge from s")
def display_values(spark, sf):
    d = lexical.score(headlines(spark, sf))
    return d.select("doc_id", T.fixed(F.col("similarity")).alias("similarity"), T.fixed(F.col("polarity")).alias("polarity"), T.yes_no(F.col("semantic_gap")).alias("semantic_gap"), F.round(T.gauge_offset(F.col("score")), 6).alias("gauge"))


@query(rf"""select doc_id, {count(TEXT, r'[\p{L}\p{N}_]+'.replace('{L}', '{{L}}').replace('{N}', '{{N}}'))} as words, substr({norm('text')}, 1, 420) || case when length({TEXT}) > 420 then '...' else '' end as snippet from documents""".replace("{{", "{").replace("}}", "}"))
def second_text_counts(spark, sf):
    return _docs(spark, sf, words=T.word_count(F.col("text")), snippet=T.snippet_dots(F.col("text")))


# ---- urls and pages -------------------------------------------------------------------------------------------------------

AUTH = "string_split(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), '@')[-1]"
URL_HOST = f"case when regexp_matches(url, '^(?i)https?://') then lower(split_part({AUTH}, ':', 1)) else case when url is not null then '' end end"
NETLOC = "replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '')"
URL_NORM = rf"""rtrim(lower(case when regexp_matches(url, '^(?i)https?://[^/?#]') then split_part(url, '://', 1) || '://' || split_part({AUTH}, ':', 1)
  || case when split_part({AUTH}, ':', 2) in ('', case when lower(url) like 'https%' then '443' else '80' end) then '' else ':' || split_part({AUTH}, ':', 2) end || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) else url end), '/')"""


@query(f"select page_id, {URL_NORM} as url_norm, {URL_HOST} as host, {NETLOC} as domain from pages")
def url_parts(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", U.normalize_url(u).alias("url_norm"), U.host(u).alias("host"), U.domain(u).alias("domain"))


@query(f"select {URL_NORM} as url_norm, min(page_id) as first_page, count(*) as n from pages group by all")
def url_dedupe(spark, sf):
    return read(spark, sf, "pages").groupBy(U.normalize_url(F.col("url")).alias("url_norm")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


@query(f"select {NETLOC} as domain, count(*) as n, sum(length(html))::bigint as chars from pages group by all")
def domain_counts(spark, sf):
    return read(spark, sf, "pages").groupBy(U.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"))


@query(f"select page_id, coalesce(regexp_matches(url, '^(?i)https?://'), false) as scheme_ok, regexp_matches({URL_HOST}, '^(localhost|.*\\.localhost|.*\\.local|metadata\\.google\\.internal)$') as blocked, octet_length(encode(html)) <= 5242880 as small from pages")
def url_guard(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", U.scheme_allowed(u).alias("scheme_ok"), U.host_blocked(U.host(u)).alias("blocked"), (F.octet_length("html") <= 5242880).alias("small"))


@query(f"""select page_id, {norm("replace(replace(replace(regexp_extract(html, '<h1[^>]*>([^<]*)', 1), '&quot;', chr(34)), '&middot;', '·'), '&amp;', '&')")} as title from pages""")
def page_title(spark, sf):
    return articles(read_texts(spark, sf, "pages", "page_id", "url", "html")).select("page_id", "title")


unescape = lambda x: f"regexp_replace(replace({x}, '&quot;', chr(34)), '&amp;?', '&', 'g')"
READABLE = f"""(length(x) >= 60 and not {NOISY} and not regexp_matches(lower(x), '{BOILERPLATE}') and len(string_split(x, ' ')) >= 10 and len(list_filter(string_split(x, ' '), lambda w: length(w) > 20)) <= 2)"""
ARTICLE = f"""g0 as (select page_id, url, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) as art, {norm("replace(replace(replace(regexp_extract(html, '<h1[^>]*>([^<]*)', 1), '&quot;', chr(34)), '&middot;', '·'), '&amp;', '&')")} as title from pages),
g1 as (select page_id, unnest(string_split(art, '<p>')[2:]) as piece, generate_subscripts(string_split(art, '<p>')[2:], 1) as pos from g0),
g2 as (select page_id, pos, {unescape("regexp_replace(split_part(piece, '</p>', 1), '<[^>]*>', '', 'g')")} as x from g1), g3 as (select page_id, pos, {SAN} as x from g2),
g4 as (select page_id, list(x order by pos) as xs from g3 where {READABLE} group by page_id),
g5 as (select page_id, array_to_string(xs[1:18], ' ') as x, array_to_string(xs[1:20], ' ') as y from g4),
g6 as (select page_id, y as x, case when length(x) > 200 and len({toks('x')}) >= 80 and not {NOISY} then x end as main from g5),
g7 as (select page_id, coalesce(main, case when not {NOISY} then x else '' end) as body, case when main is not null then 'Paragraph extraction (article p)' when length(x) > 200 and not {NOISY} then 'Readable paragraph fallback' else 'Body paragraph fallback' end as method from g6),
h as (select g0.page_id as doc_id, null as lang, url, title, title as raw, coalesce(body, '') as body, coalesce(method, 'No readable article body found') as method from g0 left join g7 on g0.page_id = g7.page_id)"""


@query(f"with {ARTICLE} select doc_id as page_id, title, body, method from h")
def page_articles(spark, sf):
    return articles(read_texts(spark, sf, "pages", "page_id", "url", "html")).select("page_id", "title", "body", "method")


@query(rf"""with {ARTICLE}, {PREP}, {SCORE}, kt as (select doc_id, {toks("title || ' ' || body")} as w from h), ke as (select doc_id, unnest(w) as tok, generate_subscripts(w, 1) as pos from kt),
kc as (select doc_id, tok, count(*) as n, min(pos) as f from ke where length(tok) > 3 and not list_contains({sql_list(STOPWORDS)}, tok) group by all), kr as (select *, row_number() over (partition by doc_id order by n desc, f) as r from kc),
k as (select doc_id, string_agg(tok, ' ' order by r) as phrases from kr where r <= 8 group by doc_id),
ne as (select doc_id, list_filter(list_transform(regexp_extract_all(title || '. ' || substr(body, 1, 2200), '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}})\b'), lambda x: {norm('x')}), lambda x: length(x) > 2 and not regexp_matches(x, '^The$|This$|That$|And$|But$')) as xs from h),
nu as (select doc_id, unnest(xs) as x, generate_subscripts(xs, 1) as pos from ne), ng as (select doc_id, x, min(pos) as pos from nu group by all), nr as (select *, row_number() over (partition by doc_id order by pos) as r from ng),
n as (select doc_id, string_agg(x, ' | ' order by r) as nouns from nr where r <= 12 group by doc_id),
sg as (select doc_id, list_filter({SENT}, lambda x: not {NOISY}) as good from h), sc as (select *, list_filter(good, lambda x: regexp_matches(lower(x), '{CUES}')) as cued from sg)
select h.doc_id as page_id, h.url, h.title as headline, h.title <> '' as headline_extracted, score, {VERDICT} as verdict, case when score >= 70 then 'risky' when score >= 40 then 'warning' else 'safe' end as bucket, 100 - score as legitimacy_confidence_score, {SUMMARY} as summary,
  case when substr(h.body, 1, 300) = '' then 'Body text was unavailable.' else substr(h.body, 1, 300) end as body_snippet, {URL_HOST} as source_domain, method as extraction_method, len({toks('h.title')}) as headline_word_count, len({toks('h.body')}) as word_count,
  greatest(1, round(len({toks('h.body')}) / 220.0)::int) as estimated_read_time_minutes, {count('h.body', r'\b\d+(?:\.\d+)?%?\b')} as numeric_claim_count, gap_points, hook_points, coalesce(phrases, '') as key_phrases, coalesce(nouns, '') as named_entities,
  array_to_string((case when len(cued) > 0 then cued else good end)[1:4], ' | ') as supporting_sentences, similarity as cosine_similarity_score, polarity as sentiment_polarity, 'Not available' as published_at, 'Not available' as meta_description, '' as authors
from h join s on s.doc_id = h.doc_id join sc on sc.doc_id = h.doc_id left join k on k.doc_id = h.doc_id left join n on n.doc_id = h.doc_id""")
def analyze_pages(spark, sf):
    d = report.analyze(read_texts(spark, sf, "pages", "page_id", "url", "html"))
    texts = {c: F.array_join(c, sep) for c, sep in (("key_phrases", " "), ("named_entities", " | "), ("supporting_sentences", " | "), ("authors", ", "))}
    d = d.withColumns(texts).withColumns({"gap_points": F.col("score_breakdown.semantic_gap_points"), "hook_points": F.col("score_breakdown.hook_points")})
    keep = """page_id url headline headline_extracted score verdict bucket legitimacy_confidence_score summary body_snippet source_domain extraction_method headline_word_count word_count estimated_read_time_minutes
      numeric_claim_count gap_points hook_points key_phrases named_entities supporting_sentences cosine_similarity_score sentiment_polarity published_at meta_description authors"""
    return d.select(*keep.split())


SECOND = f"""g as (select page_id, url, {norm(unescape("replace(regexp_extract(html, '<title>([^<]*)', 1), '&middot;', '·')"))} as headline, {norm(unescape("regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')"))} as body from pages)"""


@query(f"with {SECOND} select page_id, headline, body, case when length(body) < 80 then 'Could not extract enough article body text.' end as error from g")
def second_articles(spark, sf):
    d = html.second_articles(read_texts(spark, sf, "pages", "page_id", "url", "html"))
    return d.select("page_id", "headline", "body", html.body_error(F.col("body"))["message"].alias("error"))


@query(rf"""with {SECOND}, h as (select page_id as doc_id, url, headline, case when headline = '' then 'Article from ' || coalesce(nullif(trim({NETLOC}), ''), 'source') else headline end as title, body from g), {PREP}, {COS}, {SEMANTIC}
select h.doc_id as page_id, h.title as headline, headline <> '' as headline_extracted, score as composite_sensationalism_score, verdict, {SEM_SUMMARY} as summary, substr(h.body, 1, 420) || case when length(h.body) > 420 then '...' else '' end as body_snippet, {NETLOC} as source_domain,
  {count('h.body', r'[\p{L}\p{N}_]+'.replace('{L}', '{{L}}').replace('{N}', '{{N}}'))} as word_count, greatest(1, round_even({count('h.body', r'[\p{L}\p{N}_]+'.replace('{L}', '{{L}}').replace('{N}', '{{N}}'))} / 220.0, 0)::int) as estimated_read_time_minutes,
  {count("h.title || ' ' || substr(h.body, 1, 1800)", r'\b\d+(?:[.,]\d+)?\b')} as numeric_claim_count from h join z on z.doc_id = h.doc_id""".replace("{{", "{").replace("}}", "}"))
def analyze_pages_semantic(spark, sf):
    keep = "page_id headline headline_extracted composite_sensationalism_score verdict summary body_snippet source_domain word_count estimated_read_time_minutes numeric_claim_count"
    return report.analyze_semantic(read_texts(spark, sf, "pages", "page_id", "url", "html")).select(*keep.split())


# ---- traffic --------------------------------------------------------------------------------------------------------------


@query("select event_id, row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) as n, row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) <= 2 as accepted from events")
def rate_limit(spark, sf):
    """Two requests a day and user: the defaults never bind on these events."""
    return traffic.rate_limit(read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "event_id", 2, "1 day").select("event_id", "n", "accepted")


@query("""with e as (select event_id, event_type, epoch_us(ts) as us, row_number() over (partition by event_type order by ts, event_id) as rn from events)
select event_id, 1800000000 * rn + max(us - 1800000000 * rn) over (partition by event_type order by rn rows unbounded preceding) as start_us from e""")
def politeness_slots(spark, sf):
    return traffic.politeness(read(spark, sf, "events"), "event_type", "ts", "event_id", 1_800_000).select("event_id", "start_us")


@query("""with recursive e as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as rn from events),
f as (select user_id, event_id, rn, us + 900000000 as expires, false as hit from e where rn = 1
  union all select e.user_id, e.event_id, e.rn, case when e.us <= f.expires then f.expires else e.us + 900000000 end, e.us <= f.expires from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
select user_id, event_id, hit from f""")
def ttl_cache(spark, sf):
    return traffic.ttl_cache(read(spark, sf, "events"), "user_id", "ts", "event_id")


@query("""with recursive e as (select event_type, event_id, epoch_us(ts) as us, row_number() over (partition by event_type order by ts, event_id) as rn from events),
f as (select event_type, event_id, rn, us + 900000000 as expires, false as hit from e where rn = 1
  union all select e.event_type, e.event_id, e.rn, case when e.us <= f.expires then f.expires else e.us + 900000000 end, e.us <= f.expires from f join e on e.event_type = f.event_type and e.rn = f.rn + 1)
select event_type, event_id, hit from f""")
def robots_cache(spark, sf):
    """Rules kept by origin; here the event type stands for it."""
    return traffic.ttl_cache(read(spark, sf, "events"), "event_type", "ts", "event_id")


@query("""with recursive e as (select user_id, event_id, event_type as k, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as rn from events),
f as (select user_id, event_id, rn, [{'k': k, 'e': us + 172800000000}] as held, false as hit from e where rn = 1
  union all select user_id, event_id, rn, case when hit then list_concat(rest, mine) else list_concat(rest[greatest(1, len(rest) - 0):], [{'k': k, 'e': us + 172800000000}]) end, hit
  from (select e.user_id, e.event_id, e.rn, e.k, e.us, list_filter(f.held, lambda x: x.k <> e.k) as rest, list_filter(f.held, lambda x: x.k = e.k and e.us <= x.e) as mine, len(list_filter(f.held, lambda x: x.k = e.k and e.us <= x.e)) > 0 as hit from f join e on e.user_id = f.user_id and e.rn = f.rn + 1))
select user_id, event_id, hit from f""")
def lru_cache(spark, sf):
    """One cache of two entries per user, of two days each, so that both bounds bind."""
    return traffic.lru_cache(read(spark, sf, "events"), "user_id", "event_type", "ts", "event_id", 172_800_000, 2)


QUERIES |= cases.QUERIES
ORACLE_SQL |= cases.ORACLE_SQL
