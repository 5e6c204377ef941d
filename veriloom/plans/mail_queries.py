"""Queries over the mail tables, texts, vectors and events, each with the SQL that says the same.

Every query runs over its whole tables. Suffixes are the reserved ones, as all hosts of the data are invented.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import domains as D
from veriloom.functions import headers as H
from veriloom.functions import text as T
from veriloom.operators import allow as A
from veriloom.operators import evaluate as E
from veriloom.operators import matching as M
from veriloom.operators import perturb as P
from veriloom.operators.features import BAD_BODY, BAD_SUBJECT
from veriloom.operators.recognise import entity_scores, spans_of_tags
from veriloom.operators.verdict import verdict
from veriloom.session import table

REGISTRY: dict = {}
SQL: dict[str, str] = {}
_DOMAIN_SQL = r"'([a-z0-9-]+\.(?:co\.)?(?:example|test|invalid))$'"
_EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_URL_SQL = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s<>()\[\]\x22'']*)?"


def query(name: str, sql: str | None = None):
    def add(f):
        REGISTRY[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _reg(host):
    return D.registrable(host, D.RESERVED)


# ---------------------------------------------------------------- domains and senders


@query("reg_domains", f"""
    select regexp_extract(lower(trim(from_domain)), {_DOMAIN_SQL}, 1) as domain, count(*) as mails, count(distinct user_name) as users
    from mail_meta where from_domain is not null group by 1""")
def reg_domains(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "mail_meta").where("from_domain is not null")
    return m.groupBy(F.coalesce(_reg(F.col("from_domain")), F.lit("")).alias("domain")).agg(F.count(F.lit(1)).alias("mails"), F.countDistinct("user_name").alias("users"))


@query("sender_keys", f"""
    select case when regexp_extract(h, {_DOMAIN_SQL}, 1) in ('letterbox.example', 'postkorb.example') then lower(trim(sender))
      else coalesce(nullif(regexp_extract(h, {_DOMAIN_SQL}, 1), ''), h) end as sender_key, count(*) as n
    from (select *, case when contains(sender, '@') then lower(regexp_extract(trim(sender), '([^@]*)$', 1)) else lower(trim(sender)) end as h from decision where sender is not null) group by 1""")
def sender_keys(s: SparkSession, d: str) -> DataFrame:
    key = D.sender_key(F.col("sender"), D.RESERVED, ["letterbox.example", "postkorb.example"])
    senders = table(s, d, "decision").where("sender is not null").groupBy("sender").agg(F.count(F.lit(1)).alias("n"))  # each sender's key once
    return senders.groupBy(key.alias("sender_key")).agg(F.sum("n").alias("n"))


@query("kb_domain_list", f"""
    select brand, domain, regexp_extract(domain, {_DOMAIN_SQL}, 1) as registrable
    from (select distinct brand, lower(trim(x)) as domain from (select brand, unnest(domains) as x from kb))""")
def kb_domain_list(s: SparkSession, d: str) -> DataFrame:
    from veriloom.sources.mail import kb_domains

    return kb_domains(table(s, d, "kb"), D.RESERVED)


@query("allowed_hosts", """
    select k.brand, count(*) as mails from (select distinct brand, lower(trim(x)) as domain from (select brand, unnest(domains) as x from kb)) k
    join mail_meta m on lower(trim(m.from_domain)) = k.domain or ends_with(lower(trim(m.from_domain)), '.' || k.domain) group by 1""")
def allowed_hosts(s: SparkSession, d: str) -> DataFrame:
    """Mails from a brand's hosts or hosts below them: hosts are exploded upwards, so the test is an equi-join. A mail
    under two of a brand's domains counts for both."""
    kb = table(s, d, "kb").select("brand", F.explode("domains").alias("x")).select("brand", F.lower(F.trim("x")).alias("domain")).distinct()
    hosts = table(s, d, "mail_meta").groupBy("from_domain").agg(F.count(F.lit(1)).alias("n"))
    up = hosts.select("n", F.explode(D.host_suffixes(F.col("from_domain"))).alias("domain"))
    return up.join(kb, "domain").groupBy("brand").agg(F.sum("n").alias("mails"))


@query("domain_overlap", f"""
    select overlap, count(*) as n from (select list_has_any([split_part(regexp_extract(lower(trim(q.sender_domain)), {_DOMAIN_SQL}, 1), '.', 1)], list_transform(k.domains, lambda x: split_part(regexp_extract(lower(x), {_DOMAIN_SQL}, 1), '.', 1))) as overlap
    from req2_llm_classified q join kb k on q.claimed_organization = k.brand where q.sender_domain is not null) group by 1""")
def domain_overlap(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "req2_llm_classified").where("sender_domain is not null")
    both = q.join(table(s, d, "kb"), q["claimed_organization"] == F.col("brand"))
    return both.groupBy(D.domains_overlap(F.array("sender_domain"), F.col("domains"), D.RESERVED).alias("overlap")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- mail stream and decisions


@query("results_meta", """
    select d.action, m.auth_status, count(*) as n, count(distinct d.user_name) as users
    from (select distinct * from decision) d join (select join_key, min(auth_status) as auth_status from mail_meta group by 1) m on d.join_key = m.join_key group by 1, 2""")
def results_meta(s: SparkSession, d: str) -> DataFrame:
    meta = table(s, d, "mail_meta").groupBy("join_key").agg(F.min("auth_status").alias("auth_status"))
    return E.join_results_meta(table(s, d, "decision").distinct(), meta).groupBy("action", "auth_status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_name").alias("users"))


@query("auth_alignment", """
    select m.auth_status, list_contains(k.domains, m.auth_domain) as aligned, count(*) as n
    from (select distinct join_key, claimed_identity from decision) d
    join (select join_key, min(auth_status) as auth_status, min(nullif(auth_domain, '')) as auth_domain from mail_meta group by 1) m on d.join_key = m.join_key
    join kb k on lower(trim(d.claimed_identity)) = lower(k.brand) where m.auth_domain is not null group by 1, 2""")
def auth_alignment(s: SparkSession, d: str) -> DataFrame:
    meta = table(s, d, "mail_meta").groupBy("join_key").agg(F.min("auth_status").alias("auth_status"), F.min(F.nullif("auth_domain", F.lit(""))).alias("auth_domain")).where("auth_domain is not null")
    kb = table(s, d, "kb").select(F.lower("brand").alias("b"), "domains")
    said = table(s, d, "decision").select("join_key", "claimed_identity").distinct()
    both = said.join(kb, F.lower(F.trim("claimed_identity")) == F.col("b")).join(meta, "join_key")
    return both.groupBy("auth_status", F.array_contains("domains", F.col("auth_domain")).alias("aligned")).agg(F.count(F.lit(1)).alias("n"))


_CONTACT_SQL = """(select *, flagged and join_key = min(case when flagged then join_key end) over (partition by user_name, sender, claimed) as is_first
    from (select distinct join_key, user_name, sender, lower(trim(claimed_identity)) as claimed, pred_phish as flagged from decision where claimed_identity is not null))"""


def _contacts(s: SparkSession, d: str) -> DataFrame:
    mails = table(s, d, "decision").where("claimed_identity is not null").select("join_key", "user_name", "sender", F.lower(F.trim("claimed_identity")).alias("claimed"), F.col("pred_phish").alias("flagged")).distinct()
    return A.first_contacts(mails, ["user_name", "sender", "claimed"], ["join_key"], F.coalesce("flagged", F.lit(False)), F.lit(False))


@query("first_contact", f"""
    select join_key, user_name, sender, claimed, case when not coalesce(flagged, false) then 'ok' when is_first then 'flag_first_contact' else 'whitelist_suppressed' end as action from {_CONTACT_SQL}""")
def first_contact(s: SparkSession, d: str) -> DataFrame:
    return _contacts(s, d).select("join_key", "user_name", "sender", "claimed", "action")


@query("first_contact_rates", f"""
    select count(*) as mails, round(count(*) filter (flagged) / count(*), 9) as static_fpr, round(count(*) filter (is_first) / count(*), 9) as adaptive_fpr,
      round(1 - count(*) filter (is_first) / count(*) filter (flagged), 9) as reduction, 0::bigint as exempt, count(*) filter (is_first) as alerts from {_CONTACT_SQL}""")
def first_contact_rates(s: SparkSession, d: str) -> DataFrame:
    return E.rates(_contacts(s, d))


@query("interactions_per_user", f"""
    select count(*) as users, round(avg(n), 9) as mean, list_sort(list(n))[count(*) // 2 + 1] as upper_median, max(n) as most
    from (select user_name, count(*) as n from {_CONTACT_SQL} where is_first group by 1)""")
def interactions_per_user(s: SparkSession, d: str) -> DataFrame:
    return E.interactions(_contacts(s, d), "user_name")


@query("running_fp", """
    select event_id, sum(case when event_type = 'error' then 1 else 0 end) over w::bigint as running_flagged, sum(user_id) over w::bigint as running_users
    from events window w as (order by ts, event_id rows unbounded preceding)""".replace("over w::bigint", "over w").replace("sum(case", "(sum(case").replace("end) over w", "end) over w)::bigint").replace("sum(user_id) over w", "(sum(user_id) over w)::bigint"))
def running_fp(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "ts", (F.col("event_type") == "error").cast("long").alias("flagged"), F.col("user_id").alias("users"))
    out = A.running_totals(e, ["ts", "event_id"], ["flagged", "users"], F.date_trunc("hour", "ts"))
    return out.select("event_id", "running_flagged", "running_users")


@query("event_first_contact", """
    select event_id, case when event_type <> 'error' then 'ok' when row_number() over (partition by user_id, floor(value), event_type order by ts, event_id) = 1 then 'flag_first_contact' else 'whitelist_suppressed' end as action from events""")
def event_first_contact(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("claimed", F.floor("value"))
    return A.first_contacts(e, ["user_id", "claimed"], ["ts", "event_id"], F.col("event_type") == "error", F.lit(False)).select("event_id", "action")


@query("per_user_cap", "select join_key, user_name, seq from (select *, row_number() over (partition by user_name order by join_key) - 1 as seq from (select distinct join_key, user_name from mail_meta where user_name is not null)) where seq < 20")
def per_user_cap(s: SparkSession, d: str) -> DataFrame:
    """The first 20 mails of each user by key, numbered from 0."""
    m = table(s, d, "mail_meta").where("user_name is not null").select("join_key", "user_name").distinct()
    return A.per_user_sequence(m, "user_name", ["join_key"], 20)


@query("resume_anti", "select distinct join_key from mail_meta m where not exists (select 1 from decision d where d.join_key = m.join_key)")
def resume_anti(s: SparkSession, d: str) -> DataFrame:
    from veriloom.sources.mail import not_yet_done

    return not_yet_done(table(s, d, "mail_meta").select("join_key").distinct(), table(s, d, "decision"), "join_key")


@query("semi_texts", "select doc_id from documents t where exists (select 1 from decision d where d.join_key = t.join_key)")
def semi_texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").join(table(s, d, "decision"), "join_key", "left_semi").select("doc_id")


@query("allow_mark", """
    with allow as (select distinct user_name, sender, lower(trim(claimed_identity)) as target from decision where action = 'whitelist_suppressed' and user_name is not null and sender is not null and claimed_identity is not null)
    select d.pred_phish, a.target is not null as allowed, count(*) as n from decision d left join allow a on d.user_name = a.user_name and d.sender = a.sender and lower(trim(d.claimed_identity)) = a.target group by 1, 2""")
def allow_mark(s: SparkSession, d: str) -> DataFrame:
    mails = table(s, d, "decision").select(F.col("user_name").alias("user"), F.col("sender").alias("sender_key"), F.lower(F.trim("claimed_identity")).alias("claimed_identity"), "pred_phish", "action")
    pairs = mails.where("action = 'whitelist_suppressed' and user is not null").select("user", "sender_key", F.col("claimed_identity").alias("target"))
    return A.mark_allowed(mails, pairs).groupBy("pred_phish", "allowed").agg(F.count(F.lit(1)).alias("n"))


@query("action_breakdown", """
    select action as status, count(*) as n, count(*) filter (static_fp) as hits, grouping(action)::int as total from decision group by rollup (action)""")
def action_breakdown(s: SparkSession, d: str) -> DataFrame:
    return E.breakdown(table(s, d, "decision").withColumnRenamed("action", "status"), "status", F.col("static_fp"))


@query("rate_by_auth", "select auth_status, count(*) as n, round(avg(case when epoch is not null and not isnan(epoch) then 1.0 else 0.0 end), 9) as rate from mail_meta group by 1")
def rate_by_auth(s: SparkSession, d: str) -> DataFrame:
    return E.rate_by(table(s, d, "mail_meta"), "auth_status", F.col("epoch").isNotNull() & ~F.isnan("epoch"))


@query("late_mail", """
    select date_diff('day', to_timestamp(epoch)::timestamp::date, loaded_at::timestamp::date) > 7 as late, count(*) as n from mail_meta where epoch is not null and not isnan(epoch) and epoch between 1500000000 and 1800000000 group by 1""")
def late_mail(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "mail_meta").where("epoch between 1500000000 and 1800000000")
    return m.groupBy((F.datediff(F.to_date("loaded_at"), F.to_date(F.timestamp_seconds(F.floor("epoch")))) > 7).alias("late")).agg(F.count(F.lit(1)).alias("n"))


@query("keys_of_both", "select join_key from (select join_key from mail_meta intersect select join_key from decision)")
def keys_of_both(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mail_meta").select("join_key").intersect(table(s, d, "decision").select("join_key"))


@query("keys_of_one", "select join_key, 'decision' as only_in from (select join_key from decision except select join_key from mail_meta) union all select join_key, 'mail' as only_in from (select join_key from mail_meta except select join_key from decision)")
def keys_of_one(s: SparkSession, d: str) -> DataFrame:
    m, k = table(s, d, "mail_meta").select("join_key"), table(s, d, "decision").select("join_key")
    only = lambda a, b, n: a.exceptAll(b).distinct().join(b, "join_key", "left_anti").withColumn("only_in", F.lit(n))
    return only(k, m, "decision").unionByName(only(m, k, "mail"))


# ---------------------------------------------------------------- classified rows


@query("official_states", """
    select case when lower(trim(from_address_is_official)) in ('true','yes','y','t','1','1.0') then true when lower(trim(from_address_is_official)) in ('false','no','n','f','0','0.0') then false end as official, label, count(*) as n
    from req2_llm_classified group by 1, 2""")
def official_states(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "req2_llm_classified").groupBy(H.tri_state(F.col("from_address_is_official")).alias("official"), "label").agg(F.count(F.lit(1)).alias("n"))


@query("reply_subjects", """
    select contains(l, 're:') or contains(l, 'fwd:') or contains(l, 'fw:') or contains(l, '回复:') or contains(l, '转发:') or contains(l, 'reply:') as skipped, count(*) as n
    from (select lower(coalesce(subject, '')) as l from req2_llm_classified) group by 1""")
def reply_subjects(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "req2_llm_classified").groupBy(H.is_reply_subject(F.col("subject")).alias("skipped")).agg(F.count(F.lit(1)).alias("n"))


@query("path_users", """
    select case when regexp_extract(file, '(?:^|/)field/([^/]+)/', 1) <> '' then regexp_extract(file, '(?:^|/)field/([^/]+)/', 1) when contains(file, '/') then string_split(file, '/')[-2] end as user_name, count(*) as n
    from req2_llm_classified group by 1""")
def path_users(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "req2_llm_classified").groupBy(H.user_of_path(F.col("file")).alias("user_name")).agg(F.count(F.lit(1)).alias("n"))


@query("truthy_labels", "select (label >= 0.5) as yes, count(*) as n from req2_llm_classified group by 1")
def truthy_labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "req2_llm_classified").groupBy(H.truthy(F.col("label")).alias("yes")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- texts


@query("email_extract", f"select doc_id, unnest(regexp_extract_all(text, '{_EMAIL_SQL}')) as address from documents where text is not null")
def email_extract(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.explode(D.emails_in(F.col("text"))).alias("address"))


@query("email_clean", f"""
    select doc_id, count(distinct lower(a)) as addresses from (select doc_id, unnest(regexp_extract_all(text, '{_EMAIL_SQL}')) as a from documents where text is not null) group by 1""")
def email_clean(s: SparkSession, d: str) -> DataFrame:
    got = table(s, d, "documents").select("doc_id", F.size(D.clean_emails(D.emails_in(F.col("text")))).cast("long").alias("addresses"))
    return got.where("addresses > 0")


@query("email_domains", f"""
    select regexp_extract(lower(regexp_extract(a, '([^@]*)$', 1)), {_DOMAIN_SQL}, 1) as domain, count(*) as n from (select unnest(regexp_extract_all(text, '{_EMAIL_SQL}')) as a from documents where text is not null) group by 1""")
def email_domains(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "documents").select(F.explode(D.emails_in(F.col("text"))).alias("a"))
    return a.groupBy(F.coalesce(_reg(D.email_host(F.col("a"))), F.lit("")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("url_hosts", f"""
    select regexp_replace(lower(regexp_extract(u, '^https?://([^/:?#]+)', 1)), '^www\\.', '') as host, count(*) as n from (select doc_id, unnest(list_distinct(regexp_extract_all(text, '{_URL_SQL}'))) as u from documents where text is not null) group by 1""")
def url_hosts(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "documents").select(F.explode(D.urls_in(F.col("text"))).alias("u"))
    return u.groupBy(D.host_of(F.col("u")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("site_roots", f"""
    select doc_id, count(distinct regexp_extract(u, '^(https?)://', 1) || regexp_replace(lower(regexp_extract(u, '^https?://([^/:?#]+)', 1)), '^www\\.', '')) as roots from (select doc_id, unnest(regexp_extract_all(text, '{_URL_SQL}')) as u from documents where text is not null) group by 1""")
def site_roots(s: SparkSession, d: str) -> DataFrame:
    got = table(s, d, "documents").select("doc_id", F.size(D.site_roots(D.urls_in(F.col("text")))).cast("long").alias("roots"))
    return got.where("roots > 0")


@query("link_topk", f"""
    select doc_id, url, rn from (select doc_id, url, row_number() over (partition by doc_id order by p desc, url) as rn
      from (select doc_id, url, 2 * list_sum(list_transform(['contact', 'support', 'help', 'about', 'legal', 'privacy', 'impressum', 'kontakt', 'customer', 'service', 'connect', 'reach', 'team', 'career', 'press', 'investor',
          'sitemap', 'site-map', 'abuse', 'phishing', 'foot', 'get-in', 'inquiry', 'inquiries', 'ayuda', 'aide', 'contacto', 'contato', 'kund', 'kunden', 'fraud'], lambda h: case when contains(pq, h) then 1 else 0 end))
          + case when regexp_matches(pq, '/(contact|support|help|legal|impress|privacy|kontakt|mail)(/|$|\\.html?)') then 1 else 0 end as p
        from (select doc_id, url, case when regexp_extract(r, '^[^?#]*') = '' then '/' else regexp_extract(r, '^[^?#]*') end || '?' || regexp_extract(r, '^[^?#]*[?]([^#]*)', 1) as pq
        from (select doc_id, url, regexp_replace(lower(url), '^https?://[^/?#]*', '') as r from (select distinct doc_id, unnest(regexp_extract_all(text, '{_URL_SQL}')) as url from documents where text is not null))))) where rn <= 6""")
def link_topk(s: SparkSession, d: str) -> DataFrame:
    """The six most promising links of each text."""
    u = table(s, d, "documents").select("doc_id", F.explode(D.urls_in(F.col("text"))).alias("url"))
    top = E.top_links(u.withColumn("priority", D.link_priority(F.col("url"))).withColumn("hop", F.lit(1)), "doc_id", "url", "priority", "hop")
    return top.select("doc_id", "url", F.col("rn").cast("long").alias("rn"))


@query("url_argmax", f"""
    select doc_id, arg_max(url, (length(url), -pos)) as url, coalesce(max(length(url)), 0)::double as score from (select d.doc_id, u.url, u.pos from documents d left join (select doc_id, unnest(us) as url, generate_subscripts(us, 1) as pos from (select doc_id, list_distinct_ordered as us from (select doc_id, regexp_extract_all(text, '{_URL_SQL}') as list_distinct_ordered from documents where text is not null))) u on d.doc_id = u.doc_id where d.text is not null) group by 1""")
def url_argmax(s: SparkSession, d: str) -> DataFrame:
    """The longest URL of each text, the first among equally long ones; a text without one has a row with score 0."""
    all_urls = F.regexp_extract_all("text", F.lit(f"({D.URL})"), F.lit(1))
    u = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode_outer(all_urls).alias("pos", "url")).withColumn("score", F.coalesce(F.length("url"), F.lit(0)).cast("double"))
    return E.best_per(u, "doc_id", "score", "pos", ["url"]).select("doc_id", "url", "score")


@query("shrink_urls", r"""
    select doc_id, length(regexp_replace(text, '(https?://(?:[A-Za-z0-9-]+\.){2,}[A-Za-z]{2,})(?::[0-9]+)?(?:[/?#][^\s)>\]]*)?', '\1', 'g')) as n from documents where text is not null and ascii_only""".replace(" and ascii_only", ""))
def shrink_urls(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", F.length(T.shrink_urls(F.col("text"))).cast("long").alias("n"))


@query("reply_cut", r"""
    select doc_id, length(string_split_regex(text, '-{2,}\s*Original Message\s*-{2,}|-{2,}\s*Forwarded [Mm]essage\s*-{2,}')[1]) as n from documents where text is not null""")
def reply_cut(s: SparkSession, d: str) -> DataFrame:
    cut = T.cut_reply(F.col("text"), [r"-{2,}[\t\n\f\r ]*Original Message[\t\n\f\r ]*-{2,}", r"-{2,}[\t\n\f\r ]*Forwarded [Mm]essage[\t\n\f\r ]*-{2,}"])
    return table(s, d, "documents").where("text is not null").select("doc_id", F.length(cut).cast("long").alias("n"))


@query("bad_words", """
    select doc_id, list_sum(list_transform(['link', 'click', 'confirm', 'user', 'customer', 'client', 'suspend', 'restrict', 'verify', 'payment', 'protect'], lambda w: (length(lower(text)) - length(replace(lower(text), w, ''))) // length(w)))::bigint as body,
      list_sum(list_transform(['verify', 'bank', 'debit', 'payment', 'suspend'], lambda w: (length(lower(coalesce(subject, ''))) - length(replace(lower(coalesce(subject, '')), w, ''))) // length(w)))::bigint as subject from documents where text is not null""")
def bad_words(s: SparkSession, d: str) -> DataFrame:
    """Words of the two lists in body and subject."""
    subject = T.bad_word_count(F.coalesce("subject", F.lit("")), BAD_SUBJECT).cast("long")
    return table(s, d, "documents").where("text is not null").select("doc_id", T.bad_word_count(F.col("text"), BAD_BODY).cast("long").alias("body"), subject.alias("subject"))


@query("sensitive_words", """
    select doc_id, round(list_sum(list_transform(['user', 'pass', 'password', 'credit', 'card', 'login', 'name', 'account', 'id', 'submit', 'alert', 'warning', 'sign', 'access'], lambda w: case when contains(lower(text), w) then 1 else 0 end)) / 14, 9) as ratio from documents where text is not null""")
def sensitive_words(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", F.round(T.sensitive_ratio(F.col("text")), 9).alias("ratio"))


@query("word_counts", r"""
    select doc_id, len(w)::bigint as words, len(list_distinct(w))::bigint as distinct_words from (select doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r]+'), lambda x: x <> '') as w from documents where text is not null)""")
def word_counts(s: SparkSession, d: str) -> DataFrame:
    w = F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda x: x != "")
    return table(s, d, "documents").where("text is not null").select("doc_id", F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct_words"))


@query("text_dedup", "select min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by md5(text)")
def text_dedup(s: SparkSession, d: str) -> DataFrame:
    """One row for each distinct text: the first id and how many have it. Hashes are shuffled, not texts."""
    return table(s, d, "documents").where("text is not null").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query("left_joins", """
    select t.doc_id, m.auth_status, d.action from documents t left join (select join_key, min(auth_status) as auth_status from mail_meta group by 1) m on t.join_key = m.join_key
    left join (select join_key, max(action) as action from decision group by 1) d on t.join_key = d.join_key""")
def left_joins(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "mail_meta").groupBy("join_key").agg(F.min("auth_status").alias("auth_status"))
    k = table(s, d, "decision").groupBy("join_key").agg(F.max("action").alias("action"))
    return table(s, d, "documents").select("doc_id", "join_key").join(m, "join_key", "left").join(k, "join_key", "left").select("doc_id", "auth_status", "action")


@query("first_sentences", r"""
    select doc_id, length(s[1]) as first_length, len(s)::bigint as sentences from (select doc_id, list_filter(string_split_regex(text, '\.[ \t\n\r]+'), lambda x: trim(x, ' ') <> '') as s from documents where text is not null) where len(s) > 0""")
def first_sentences(s: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.split("text", r"\.[ \t\n\r]+"), lambda x: F.trim(x) != "")
    return table(s, d, "documents").where("text is not null").withColumn("p", parts).where(F.size("p") > 0).select("doc_id", F.length(F.element_at("p", 1)).cast("long").alias("first_length"), F.size("p").cast("long").alias("sentences"))


@query("text_chunks", r"""
    select doc_id, ceil(len(w) / 50.0)::bigint as chunks from (select doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f\x0b]+'), lambda x: x <> '') as w from documents where text is not null)""")
def text_chunks(s: SparkSession, d: str) -> DataFrame:
    chunks = T.chunk_words(F.col("text"), 50, "Body:")
    return table(s, d, "documents").where("text is not null").select("doc_id", F.coalesce(F.size(chunks), F.lit(0)).cast("long").alias("chunks")).withColumn("chunks", F.greatest("chunks", F.lit(0)))


@query("typo_names", """
    select brand, brand[1] || brand[2] || brand[2] || substr(brand, 3) as repeated, brand[1] || substr(brand, 3) as deleted, brand[1] || brand[3] || brand[2] || substr(brand, 4) as switched from kb where regexp_matches(brand[2], '^[A-Za-z]$')""")
def typo_names(s: SparkSession, d: str) -> DataFrame:
    kb = table(s, d, "kb").where(F.substring("brand", 2, 1).rlike("^[A-Za-z]$"))
    b = F.col("brand")
    return kb.select("brand", P.typo(b, "repeat").alias("repeated"), P.typo(b, "delete").alias("deleted"), P.typo(b, "switch").alias("switched"))


# ---------------------------------------------------------------- vectors


_PAIR_SQL = "select a.vec_id as a, b.vec_id as b, list_dot_product(a.embedding::double[], b.embedding::double[]) as ip from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0"


@query("nn_top1", f"select a as vec_id, arg_min(b, (-round(ip, 9), b)) as neighbour, round(max(ip), 4) as score from ({_PAIR_SQL}) group by 1")
def nn_top1(s: SparkSession, d: str) -> DataFrame:
    """Nearest other vector of every row whose id is divisible by 50, against all rows."""
    return _neighbours(s, d, 1).select("vec_id", "neighbour", F.round("score", 4).alias("score"))


@query("nn_topk", f"select a as vec_id, b as neighbour, rank from (select a, b, row_number() over (partition by a order by round(ip, 9) desc, b)::int as rank from ({_PAIR_SQL})) where rank <= 5")
def nn_topk(s: SparkSession, d: str) -> DataFrame:
    return _neighbours(s, d, 5).select("vec_id", "neighbour", "rank")


@query("nn_threshold", f"select a as vec_id, count(*) as near from (select a, b, row_number() over (partition by a order by ip desc) as r, ip from ({_PAIR_SQL})) where r <= 20 and ip >= 0.4 group by 1")
def nn_threshold(s: SparkSession, d: str) -> DataFrame:
    """How many other vectors have an inner product of at least 0.4 with a row whose id is divisible by 50. All of them count,
    while the SQL stops at 20: the two agree where no row has more."""
    e = table(s, d, "embeddings")
    return M.count_near(e.where("vec_id % 50 = 0"), "vec_id", "embedding", e, "vec_id", "embedding", 0.4, exclude_self=True)


def _by_cells(s: SparkSession, d: str, k: int) -> DataFrame:
    e = table(s, d, "embeddings")
    base = e.select(F.col("vec_id").alias("neighbour"), "embedding")
    return M.nearest_by_cells(e.where("vec_id % 50 = 0"), "vec_id", "embedding", base, "neighbour", "embedding", k, exclude_self=True)


@query("nn_cells")
def nn_cells(s: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors by the approximate index: every row whose id is divisible by 50 against all rows."""
    return _by_cells(s, d, 5).withColumn("score", F.round("score", 6))


@query("nn_cells_recall")
def nn_cells_recall(s: SparkSession, d: str) -> DataFrame:
    """How much of the exact result the approximate index finds."""
    return M.recall(_by_cells(s, d, 5), _neighbours(s, d, 5), "vec_id", "neighbour")


def _neighbours(s: SparkSession, d: str, k: int) -> DataFrame:
    e = table(s, d, "embeddings")
    base = e.select(F.col("vec_id").alias("neighbour"), "embedding")
    return M.nearest(e.where("vec_id % 50 = 0"), "vec_id", "embedding", base, "neighbour", "embedding", k, exclude_self=True)


# ---------------------------------------------------------------- verdicts, spans, votes, stars


@query("verdict_table", """
    select event_id, case when event_type = 'click' and user_id % 5 <> 0 then 'No Prediction' when user_id % 3 = 0 and event_id % 2 = 0 and value > 10 then 'brand' when user_id % 3 = 0 and event_id % 2 = 0 then 'brand'
      when user_id % 3 = 0 then 'Consistent' when event_type = 'click' and user_id % 2 = 0 and event_id % 4 <> 0 then 'Internal: admin' when event_type = 'click' and user_id % 2 = 0 then 'Consistent: admin' else 'No Matched Brand' end as status,
      (user_id % 3 = 0 and event_id % 2 = 0 and value > 10 and not (event_type = 'click' and user_id % 5 <> 0)) or (user_id % 3 <> 0 and event_type = 'click' and user_id % 5 = 0 and user_id % 2 = 0 and event_id % 4 <> 0 and value > 10) as verdict
    from events""")
def verdict_table(s: SparkSession, d: str) -> DataFrame:
    """The decision table over derived inputs: no identity for clicks, a relation for every fifth user, a brand with
    domains for every third, requests above 10."""
    e = table(s, d, "events")
    some = lambda c, v: F.when(c, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    ids = some(F.col("event_type") != "click", "brand")
    rel = some(F.col("user_id") % 5 == 0, "admin")
    acts = some(F.col("value") > 10, "click here")
    official = some(F.col("user_id") % 3 == 0, "brand.example")
    brands = some(F.col("user_id") % 3 == 0, "brand")
    role = F.when(F.col("user_id") % 2 == 0, F.lit("admin"))
    same_official, same_recipient = F.col("event_id") % 2 != 0, F.col("event_id") % 4 == 0
    v = verdict(ids, rel, acts, F.array(), F.array(), official, brands, role, suffixes=D.RESERVED, overlaps=(same_official, same_recipient))
    return e.withColumn("v", v).select("event_id", "v.status", "v.verdict")


@query("claim_verdicts", """
    with sld as (select brand, list_filter(list_transform(domains, lambda x: regexp_extract(lower(x), '([a-z0-9-]+)[.](co[.])?(example|test|invalid)$', 1)), lambda x: x <> '') as known, len(domains) as n from kb),
      claims as (select distinct join_key, claimed_identity, sender from decision), j as (select c.*, k.brand, k.known, coalesce(k.n, 0) as n, regexp_extract(lower(trim(regexp_replace(sender, '^.*@', ''))), '([a-z0-9-]+)[.](co[.])?(example|test|invalid)$', 1) as own from claims c left join sld k on c.claimed_identity = k.brand)
    select join_key, claimed_identity, sender, case when coalesce(trim(claimed_identity), '') = '' then 'No Prediction' when n > 0 and coalesce(list_contains(known, own), false) then 'Consistent' when n > 0 then brand else 'No Matched Brand' end as status,
      coalesce(trim(claimed_identity), '') <> '' and n > 0 and not coalesce(list_contains(known, own), false) as verdict from j""")
def claim_verdicts(s: SparkSession, d: str) -> DataFrame:
    """The decision over every claim: the named brand's official domains against the sender's, by the domain overlap test."""
    claims = table(s, d, "decision").select("join_key", "claimed_identity", "sender").distinct()
    kb = table(s, d, "kb").select(F.col("brand").alias("claimed_identity"), F.array("brand").alias("brands"), F.col("domains").alias("official"))
    rows = claims.join(kb, "claimed_identity", "left")
    none = F.array().cast("array<string>")
    sender = F.when(F.contains("sender", F.lit("@")), F.col("sender")).otherwise(F.concat(F.lit("http://"), F.trim("sender")))  # an address or a domain
    ids = F.when(F.trim(F.coalesce("claimed_identity", F.lit(""))) != "", F.array("claimed_identity")).otherwise(none)
    v = verdict(ids, none, none, D.domain_set(F.array(sender), D.RESERVED), none, F.coalesce("official", none), F.coalesce("brands", none), F.lit(None).cast("string"), check_action=False, suffixes=D.RESERVED)
    return rows.withColumn("v", v).select("join_key", "claimed_identity", "sender", "v.status", "v.verdict")


@query("report_rate", "select avg(case when event_type = 'error' then 1 else 0 end)::double as rate, round(median(value), 9) as median_seconds from events")
def report_rate(s: SparkSession, d: str) -> DataFrame:
    return E.report_rate(table(s, d, "events"), F.col("event_type") == "error", F.col("value")).select("rate", F.round("median_seconds", 9).alias("median_seconds"))


@query("top_tags", "select event_type, count(*) as n from events where event_type is not null group by 1 order by n desc, 1 limit 5")
def top_tags(s: SparkSession, d: str) -> DataFrame:
    return E.top_tags(table(s, d, "events"), "event_type")


@query("match_rates", "select event_type, round(avg(case when value / 100 > 0.78 then 1 else 0 end), 9) as rate from events group by 1")
def match_rates(s: SparkSession, d: str) -> DataFrame:
    return E.match_rates(table(s, d, "events"), "event_type", F.col("value") / 100).select("event_type", F.round("rate", 9).alias("rate"))


@query("tag_spans", """
    select user_id, min(event_id) as "start", max(event_id) as "end", any_value(l) as label from (select *, sum(b) over (partition by user_id order by event_id) as run from (select *, case when l is not null and (p is null or p <> l) then 1 else 0 end as b
      from (select *, lag(l) over (partition by user_id order by event_id) as p from (select event_id, user_id, case when event_type in ('click', 'view', 'error') then event_type end as l from events)))) where l is not null group by user_id, run""")
def tag_spans(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("tag", F.when(F.col("event_type").isin("click", "view", "error"), F.concat(F.lit("I-"), F.col("event_type"))).otherwise("O"))
    return spans_of_tags(e, "user_id", "event_id", "tag", "event_type").select("user_id", "start", "end", "label")


@query("entity_f1", """
    with p as (select distinct user_id, event_type from events where value > 20), g as (select distinct user_id, event_type from events where value < 30), j as (select count(p.user_id) as np, count(g.user_id) as ng, count(*) filter (p.user_id is not null and g.user_id is not null) as h from p full join g on p.user_id = g.user_id and p.event_type = g.event_type)
    select round(h / np, 9) as precision, round(h / ng, 9) as recall, round(2 * (h / np) * (h / ng) / (h / np + h / ng), 9) as f1 from j""")
def entity_f1(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    out = entity_scores(e.where("value > 20"), e.where("value < 30"), ["user_id", "event_type"])
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("votes", "select event_id, round((value / 100 + user_id / 1000.0) / 2, 9) as score, (value / 100 + user_id / 1000.0) / 2 >= 0.2 as flagged from events")
def votes(s: SparkSession, d: str) -> DataFrame:
    p = E.vote([F.col("value") / 100, F.col("user_id") / 1000.0])
    return table(s, d, "events").select("event_id", F.round(p, 9).alias("score"), (p >= 0.2).alias("flagged"))


@query("star_rates", """
    select n.n_name as nation, count(*) as orders, round(avg(case when o.o_orderstatus = 'F' then 1.0 else 0.0 end), 9) as rate from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey group by rollup (n.n_name)""")
def star_rates(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.rollup(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 9).alias("rate"))


@query("line_revenue", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem group by 1, 2")
def line_revenue(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# ---------------------------------------------------------------- predicates and small transforms


@query("real_senders", r"""
    select coalesce(regexp_matches(lower(trim(sender_address)), '^[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+$') and not regexp_matches(lower(trim(sender_address)), '^(?:no-?reply|do-?not-?reply|postmaster|mailer-daemon|bounce[s]?|notifications?|newsletter|support|info|admin|webmaster|team|service|alerts?|list|owner)(?:[.+_-].*)?@'), false) as real, count(*) as n from mail_meta group by 1""")
def real_senders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mail_meta").groupBy(H.is_real_sender(F.col("sender_address")).alias("real")).agg(F.count(F.lit(1)).alias("n"))


@query("valid_records", "select doc_id from documents where trim(coalesce(subject, ''), ' ') <> '' and length(text) between 80 and 6000")
def valid_records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where(H.valid_record(F.col("subject"), F.col("text"))).select("doc_id")


@query("entity_clean", r"select distinct regexp_replace(trim(claimed_identity, ' '), '[()\[\]:*^]', '', 'g') as name from decision where claimed_identity is not null")
def entity_clean(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "decision").where("claimed_identity is not null").select(T.clean_entity(F.col("claimed_identity")).alias("name")).distinct()


@query("safe_names", r"select file, left(regexp_replace(regexp_replace(trim(file, ' '), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 60) as safe from (select distinct file from req2_llm_classified)")
def safe_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "req2_llm_classified").select("file").distinct().select("file", T.safe_name(F.col("file")).alias("safe"))


@query("brand_prefixes", """
    select brand, prefix from (select brand, left(first, 4) as prefix from (select distinct brand, string_split(lower(trim(x)), '.')[1] as first from (select brand, unnest(domains) as x from kb)) where length(first) >= 4
      union select brand, left(first, 6) from (select distinct brand, string_split(lower(trim(x)), '.')[1] as first from (select brand, unnest(domains) as x from kb)) where length(first) >= 6)""")
def brand_prefixes(s: SparkSession, d: str) -> DataFrame:
    kb = table(s, d, "kb").select("brand", F.explode("domains").alias("x"))
    return kb.select("brand", F.explode(D.brand_prefixes(F.col("x"))).alias("prefix")).distinct()


@query("kb_expanded", """
    select brand, count(distinct dom) as domains from (select brand, lower(x) as dom from (select brand, unnest(domains) as x from kb) union
      select claimed_organization as brand, lower(sender_domain) as dom from req2_llm_classified where lower(trim(from_address_is_official)) = 'true' and claimed_organization is not null and sender_domain is not null) group by 1""")
def kb_expanded(s: SparkSession, d: str) -> DataFrame:
    """The knowledge base with the sender domains that were found official for a claimed organisation."""
    found = table(s, d, "req2_llm_classified").where(H.tri_state(F.col("from_address_is_official")) & F.col("claimed_organization").isNotNull() & F.col("sender_domain").isNotNull())
    found = found.groupBy(F.col("claimed_organization").alias("brand")).agg(F.collect_set("sender_domain").alias("domains"))
    return M.expand_knowledge_base(s, table(s, d, "kb"), found).select("brand", F.size("domains").cast("long").alias("domains"))


@query("token_places", """
    select doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'the' and w[i + 1] = 'team'))::bigint as n from (select doc_id, string_split(lower(text), ' ') as w from documents where text is not null)""")
def token_places(s: SparkSession, d: str) -> DataFrame:
    from veriloom.functions.annotate import places

    w = F.split(F.lower("text"), " ")
    return table(s, d, "documents").where("text is not null").select("doc_id", F.size(places(w, F.array(F.lit("the"), F.lit("team")))).cast("long").alias("n"))


@query("mail_by_day", """
    select user_name, strftime(loaded_at::timestamp, '%Y-%m-%d') as day, count(*) as mails, sum(count(*)) over (partition by user_name order by strftime(loaded_at::timestamp, '%Y-%m-%d'))::bigint as so_far from mail_meta where user_name is not null group by 1, 2""")
def mail_by_day(s: SparkSession, d: str) -> DataFrame:
    """Mails per user and day with the running total; the window runs over days, not mails."""
    from pyspark.sql import Window as W

    per = table(s, d, "mail_meta").where("user_name is not null").groupBy("user_name", F.date_format("loaded_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("mails"))
    return per.withColumn("so_far", F.sum("mails").over(W.partitionBy("user_name").orderBy("day")).cast("long"))
