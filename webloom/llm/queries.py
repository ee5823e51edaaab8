"""The registered queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import byte_bpe, conversation_repair, elkan, embedding_dedup, exact_dedup, kneser_ney, language_id, mixing, sentencepiece_codec, simhash, toxicity, url_filters, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(docs: DataFrame, folds: int, held: int):
    return F.coalesce(F.crc32(docs["doc_id"].cast("string")) % folds == held, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a machine fitted outside the fold of remainder 0 of 5: (doc_id, held_out,
    score, predicted). Null, empty and very long texts are scored whole; a null id is not held out, and
    repeated rows are scored each. Without labels the score is a constant; an empty table gives no rows.
    Columns of `documents` other than the identifier and the text are not read."""
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", _fold(out, 5, 0).alias("held_out"), "score", (out["score"] >= 0.5).cast("int").alias("predicted"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more within a label: (vec_id, n_links, component_id, kept), a row a vector.
    Vectors that are null, zero, not finite or without a label link with nothing; copies and repeated ids
    count each; ties go to the smallest vec_id. An empty table gives no rows; other columns are not read."""
    return embedding_dedup.similar_groups(_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose fingerprints of 3-word shingles differ in 3 bits or less: (doc_id, fingerprint,
    component_id). Null, empty and blank texts have fingerprint zero and link like any other; texts of any
    length are read whole; copies share a component, of which the smallest doc_id is the name, and null only
    if all ids are. An empty table gives no rows; other columns are not read."""
    out = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("l0"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt outside the fold of remainder 2 of 4: (doc_id, held_out, lang_pred,
    score). A text that is null or has no letter is `und` with score 0, as is any where nothing was learnt;
    of equal languages the alphabetically first wins. Texts of any length are read whole; a null id is not
    held out, and repeated rows are judged each. An empty table gives no rows."""
    docs = _table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.fit(docs, ~_fold(docs, 4, 2)))
    return out.select("doc_id", _fold(out, 4, 2).alias("held_out"), "lang_pred", "score")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents equal but for runs of white space: (doc_id, keep_id, group_size, kept, text_sha256), dropped
    rows too. Null counts as empty; whole texts are compared; of rows with the same smallest id one is kept,
    and a null id is larger than any other. An empty table gives no rows; other columns change nothing."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for: (doc_id, source, mix_copy, text_sha256), a row a
    copy. A null source is one of its own, a null text has a null digest, rows of one id share a draw and
    are copied each. An empty table gives no rows."""
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("mix_copy").cast("long").alias("mix_copy"), F.sha2("text", 256).alias("text_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives, normalised and read back: (page_id, payload_bytes, payload_digest,
    record_type, refers_to). A null html is an empty payload; pages and urls of any length are written whole;
    of equal payloads the smallest page_id is the response, and so is each row that repeats it. An empty
    table gives no rows; other columns are not read."""
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


#: Words that op8's model looks at: each word and the two before it.
LM_ORDER = 3


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, by a model of those outside the fold of remainder 1 of 5: (doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score). Null and empty texts have one token, their
    end; long texts are scored part by part with their context; a null id is not held out and is learnt
    from; repeated rows count and are scored each. An empty table gives no rows."""
    docs = _table(spark, sf_dir, "documents")
    out = kneser_ney.fit_and_score(docs, ~_fold(docs, 5, 1), order=LM_ORDER)
    return out.select("doc_id", _fold(out, 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: (doc_id, n_pieces, ids_sha256, decoded_sha256, same). Null and
    empty texts have no pieces; texts of any length are encoded whole; repeated rows are encoded each. An
    empty table gives no rows; other columns are not read."""
    return sentencepiece_codec.round_trip(_table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: (page_id, host, path, rule, verdict, verdict_by). Urls that are null or without
    :// have empty parts and are allowed; urls and pages of any length are read whole; of rules that fit the
    longest wins; repeated rows are judged each. An empty table gives no rows."""
    return url_filters.judge(_table(spark, sf_dir, "pages"))


def url_alias_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op10, over pages to which links are added: of three pages two name one of 40 addresses as their
    canonical one, the one directly, the other by a redirect with dots and entities in it. Verdicts then go
    through components, which the pages of these tables by themselves do not have."""
    pages = _table(spark, sf_dir, "pages")
    at = F.concat(F.lit("/c/"), (F.col("page_id") % 40).cast("string"), F.lit("?a=1&amp;b=2"))
    link = F.concat(F.lit('<link rel="canonical" href="https://mirror.test'), at, F.lit('"><!-- <link rel="canonical" href="http://x.com/en/"> -->'))
    jump = F.concat(F.lit('<meta http-equiv="refresh" content="0; url=//MIRROR.test/d/..'), at, F.lit('">'))
    added = F.when(F.col("page_id") % 3 == 0, link).when(F.col("page_id") % 3 == 1, jump).otherwise("")
    return url_filters.judge(pages.withColumn("html", F.concat(added, F.coalesce("html", F.lit("")))))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to byte-level BPE ids and decoded: (doc_id, n_tokens, ids_sha256, decoded_sha256).
    Null and empty texts have no ids; texts of any length are encoded whole; repeated rows are encoded each.
    An empty table gives no rows; other columns are not read."""
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"))


def op12_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer vectors in 40 clusters after 5 rounds: (vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256). Vectors that are null, of another length than 64, or hold nulls or what is not finite
    are left out; of centroids at equal distance the smaller number wins; copies and repeated ids count each,
    and a null id is no first centroid. An empty table gives no rows; other columns are not read."""
    return elkan.cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, salt=2)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations damaged by a hash and repaired at the least cost: (conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256). Nulls in role and text are one space, a null turn comes
    first, rows of one turn are read by role and text, and a null conv_id is a conversation of its own. One
    without rows has zeros, an empty audit and the digest of nothing. An empty table gives no rows; other
    columns are not read."""
    return conversation_repair.repair(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_simhash": op3_simhash,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_poisson_mixing": op6_poisson_mixing,
    "op7_warc": op7_warc,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_url_filters": op10_url_filters,
    "url_alias_verdicts": url_alias_verdicts,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_elkan_clusters": op12_elkan_clusters,
    "op13_conversation_repair": op13_conversation_repair,
}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_AFTER = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1)"
_UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_RULED = f"""
        a as (select page_id, {_AFTER} as rest from pages),
        b as (select page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), {_UP}) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
        c as (select *, case
            when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
            when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
            when (host = 'com' or host like '%.com') and starts_with(path, '/en/') then 'com/en/'
            when (host = 'net' or host like '%.net') and starts_with(path, '/de/') then 'net/de/'
            when (host = 'org' or host like '%.org') and starts_with(path, '/es/') then 'org/es/' end as rule from b)"""


def _clusters_sql(k: int, rounds: int, dims: int) -> str:
    """Plain clustering, each round a CTE of assignments and one of centroids."""
    near = "select r, vec_id, v.e, min(struct_pack(d := list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, c := c)) as m from v, c{0} c group by all"
    steps = "".join(
        f"""
        a{i} as materialized ({near.format(i)}),
        u{i} as (select m.c as c, unnest(e) as x, generate_subscripts(e, 1) as p from a{i}),
        f{i} as (select c, p, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as x from u{i} group by c, p),
        g{i} as (select c, list(x order by p) as e from f{i} group by c),
        c{i + 1} as materialized (select c{i}.c, coalesce(g{i}.e, c{i}.e) as e from c{i} left join g{i} using (c)),"""
        for i in range(rounds)
    )
    return f"""
        with v as materialized (
            select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
            where len(embedding) = {dims} and len(list_filter(embedding, lambda z: z is null or not isfinite(z))) = 0),
        h as (select e, sha256('2:' || vec_id) as h from v where vec_id is not null order by h, e limit {k}),
        c0 as materialized (select (row_number() over (order by h, e) - 1)::int as c, e from h),{steps}
        z as ({near.format(rounds)})
        select vec_id, m.c as cluster, m.d as distance, (sum(m.d) over (partition by m.c))::bigint as cluster_inertia, (sum(m.d) over ())::bigint as inertia,
               sha256(array_to_string(c{rounds}.e, ',')) as centroid_sha256
        from z join c{rounds} on c{rounds}.c = m.c"""


def _repair_sql() -> str:
    """The search over all edits, turn by turn, with the cheapest (cost, audit, text) of each state."""
    grown = lambda s, cost, letter, line: f"struct_pack(c := ({s}).c + {cost}, a := ({s}).a || '{letter}', r := ({s}).r || {line})"
    least = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
    drop = lambda q: grown(f"s.s{q}", 2, "D", "''")
    keep = lambda q, initial: grown(f"s.s{q}", f"case when o.role[1] = '{initial}' then o.more else 1000000 end", "K", "(chr(10) || o.role || ':' || o.text)")
    role = lambda q, new: grown(f"s.s{q}", "o.more + 1", "R", f"(chr(10) || '{new}:' || o.text)")
    add = lambda s, new: grown(s, 5, "I", f"(chr(10) || '{new}:')")
    never, start = "struct_pack(c := 100000000, a := '', r := '')", "struct_pack(c := 0, a := '', r := '')"
    closed = f"{least('x2', add('x0', 'user'), add('x1', 'user'), add('x3', 'user'))} as s2, {least('x3', add('s2', 'assistant'))} as s3"
    return rf"""
        with recursive t(i, c, k) as (
            select i, i::ubigint, 0 from range(256) r(i)
            union all select i, case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from t where k < 8),
        l as (select list(c order by i) as l from t where k = 8),
        h as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                   xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda z: ascii(z)::ubigint)),
                       lambda x, y: xor(x >> 8, l.l[(xor(x, y) % 256)::int + 1]))) % 20 as k
            from conversations, l),
        d as (
            select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                   unnest(generate_series(1, case k when 0 then 0 when 3 then 2 else 1 end)) as copy
            from h),
        n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from d),
        b as (
            select *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) as last, row_number() over (partition by conv_id, role, text order by i) > 1 as seen,
                   lag(role) over (partition by conv_id order by i) as before
            from n),
        o as (
            select *, case when last = '' then 'blank' when seen then 'duplicate' when last in ('.', '!', '?') then '' else 'truncated' end as kind,
                   case when last = '' or seen then 1000000 when last in ('.', '!', '?') then 0 else 5 end as more
            from b),
        w as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where kind = 'blank') as blank, count(*) filter (where kind = 'duplicate') as duplicate,
                   count(*) filter (where kind = 'truncated') as truncated, count(*) filter (where before is not null and before[1] || role[1] not in ('su', 'ua', 'au')) as illegal
            from o group by conv_id),
        s(conv_id, i, s0, s1, s2, s3) as (
            select conv_id, 0::bigint, x0, x1, s2, s3
            from (select *, {closed} from (select conv_id, {start} as x0, {never} as x1, {never} as x2, {never} as x3 from (select distinct conv_id from conversations)))
            union all
            select conv_id, i, x0, x1, s2, s3
            from (select *, {closed} from (
                select s.conv_id, o.i,
                       {least(drop(0), keep(0, ""))} as x0,
                       {least(drop(1), keep(0, "s"), keep(1, ""))} as x1,
                       {least(drop(2), *(keep(q, "u") for q in (0, 1, 3)), *(role(q, "user") for q in (0, 1, 3)), keep(2, ""))} as x2,
                       {least(drop(3), keep(2, "a"), role(2, "assistant"), keep(3, ""))} as x3
                from s join o on o.conv_id is not distinct from s.conv_id and o.i = s.i + 1))),
        e as (select conv_id, arg_max({least("s0", "s3")}, i) as e from s group by conv_id)
        select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
               coalesce(illegal, 0)::bigint as illegal, e.c::bigint as cost, e.a as audit, sha256(substr(e.r, 2)) as repaired_sha256
        from e left join w on w.conv_id is not distinct from e.conv_id"""


SQL = {
    "op12_elkan_clusters": _clusters_sql(40, 5, 64),
    "op13_conversation_repair": _repair_sql(),
    "op2_embedding_dedup": """
        with recursive v as (
            select vec_id, label, embedding::double[] as e from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len(list_filter(embedding, lambda z: z is null or not isfinite(z))) = 0 and len(list_filter(embedding, lambda z: z <> 0)) > 0),
        p as (
            select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
            where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98),
        r(x, y) as (select vec_id, vec_id from v union select r.x, p.y from r join p on r.y = p.x),
        c as (select x, min(y) as component_id from r group by x), n as (select x, count(*) as n from p group by x)
        select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept
        from embeddings left join c on c.x = vec_id left join n on n.x = vec_id""",
    "op5_exact_dedup": f"""
        with n as (select doc_id, {_NORM} as norm from documents)
        select doc_id, min(doc_id) over (partition by norm) as keep_id,
               count(*) over (partition by norm) as group_size,
               doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from n""",
    "op6_poisson_mixing": """
        with recursive c as (select source, count(*) as n, pow(count(*)::double, 0.5) as share from documents group by source),
        r as (select source, (select sum(n) from c)::double * share / (select sum(share) from c) / n as rate from c),
        d as (
            select source, rate, 0 as k, exp(-rate) as term, exp(-rate) as below from r
            union all
            select source, rate, k + 1, term * rate / (k + 1), below + term * rate / (k + 1) from d where k < 119),
        u as (
            select doc_id, source, text,
                   cast('0x' || substr(md5(concat_ws(':', '17', '0', doc_id::varchar)), 1, 13) as bigint)::double / 4503599627370496.0 as u
            from documents),
        m as (
            select u.doc_id, u.source, u.text, count(*) filter (where d.below <= u.u) as copies
            from u join d on u.source is not distinct from d.source group by all)
        select doc_id, source, unnest(generate_series(0, copies - 1)) as mix_copy, sha256(text) as text_sha256 from m where copies > 0""",
    "op7_warc": """
        with p as (select page_id, coalesce(html, '') as t, octet_length(encode(coalesce(html, '')))::bigint as n from pages),
        m as (select *, case when n >= 100 then min(page_id) over (partition by t) end as first from p)
        select page_id, n as payload_bytes, sha256(t) as payload_digest,
               case when page_id <> first then 'revisit' else 'response' end as record_type,
               case when page_id <> first then first end as refers_to
        from m""",
    "op10_url_filters": f"""
        with {_RULED}
        select page_id, host, path, rule,
               case when rule in ('example.net/de/8', 'com/en/', 'org/es/') then 'block' else 'allow' end as verdict,
               case when rule is null then 'default' else 'rule' end as verdict_by
        from c""",
    "url_alias_verdicts": f"""
        with recursive {_RULED},
        d as (select *, host || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as addr, page_id % 40 as mirror,
                     case when rule in ('example.net/de/8', 'com/en/', 'org/es/') then 'block' when rule is not null then 'allow' end as own from c),
        e as (select distinct addr, mirror from d where page_id % 3 < 2 and addr <> ''),
        s as (select distinct a.mirror as x, b.mirror as y from e a join e b using (addr)),
        r(x, y) as (select x, y from s union select r.x, s.y from r join s on r.y = s.x),
        g as (select mirror, min(y) as component from e join r on mirror = x group by mirror),
        v as (select component, max(own) as alias from e join g using (mirror) join d using (addr) where own is not null group by component),
        k as (select distinct addr, alias from e join g using (mirror) join v using (component))
        select page_id, host, path, rule, coalesce(own, alias, 'allow') as verdict,
               case when own is not null then 'rule' when alias is not null then 'alias' else 'default' end as verdict_by
        from d left join k using (addr)""",
}
