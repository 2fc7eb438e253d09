"""SQL twins of the catalog queries, written independently for DuckDB."""

# Suffixes that the public list lacks.
EXTRA_SUFFIXES = (
    "dynserv.com freedynamicdns.net freedynamicdns.org mooo.com myddns.me mynumber.org viewdns.net yi.org "
    "co.cc cz.cc localtunnel.me serveo.net glitch.me"
).split()
HOUR = 3_600_000_000

HOSTS = "hosts as (select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as domain from pages)"
EVENTS = f"""{HOSTS}, n_pages as (select count(*) as n from pages),
dns_events as (
  select e.event_id as seq, epoch_us(e.ts) as ts_us, epoch_us(e.ts) / 1e6 as ts,
         concat('10.0.0.', cast(e.user_id as varchar)) as src_ip, p.domain as domain,
         case e.event_type when 'view' then 'A' when 'click' then 'AAAA' when 'purchase' then 'TXT'
                           when 'signup' then 'CNAME' else 'NULL' end as qtype,
         cast(length(p.domain) as double) as length, e.event_type = 'error' as nxdomain, e.value as value,
         epoch_us(e.ts) // {HOUR} as bucket
  from events e cross join n_pages c join hosts p on p.page_id = e.event_id % c.n)"""


def _features(keys: str, frames: str) -> str:
    """Seven features of the rows that ``frames`` assigns to each key."""
    return f"""frames as ({frames}),
type_counts as (select {keys}, qtype, count(*) as c from frames group by {keys}, qtype),
entropies as (
  select {keys}, -sum((c / t) * log2(c / t)) as h
  from (select *, sum(c) over (partition by {keys}) as t from type_counts) group by {keys}),
features as (
  select {keys}, cast(count(*) as bigint) as query_rate,
         cast(count(distinct domain) as double) as unique_subdomains, round(avg(length), 6) as avg_query_len,
         round(avg(case when qtype = 'TXT' then 1.0 else 0.0 end), 6) as txt_ratio,
         round(avg(case when nxdomain then 1.0 else 0.0 end), 6) as nxdomain_rate,
         round(avg(case when qtype <> 'A' then 1.0 else 0.0 end), 6) as non_a_ratio
  from frames group by {keys}),
full_features as (
  select f.*, round(greatest(h, 0.0), 6) as record_type_entropy from features f join entropies using ({keys}))"""


def _alert_id(threat_class: str, flow: str) -> str:
    """Hash of the parts of an alert's identity, each after its length."""
    parts = (threat_class, flow, "src_ip", "cast(seq as varchar)", "cast(ts_us as varchar)")
    return "sha256(concat(" + ", ".join(f"length({x}), ':', {x}" for x in parts) + ")) as alert_id"


PER_EVENT = EVENTS + ", " + _features("seq", """
  select a.seq, x.domain, x.qtype, x.length, x.nxdomain from dns_events a join dns_events x
    on a.src_ip = x.src_ip and x.bucket between a.bucket - 11 and a.bucket and x.seq <= a.seq""")
PER_EVENT_ROWS = """select f.*, e.src_ip, e.ts_us, e.bucket from full_features f join dns_events e using (seq)"""
PER_SLIDE = EVENTS + ", " + _features("src_ip, slide", """
  select src_ip, bucket + unnest(range(0, 12)) as slide, domain, qtype, length, nxdomain from dns_events""")

LINES = EVENTS + """,
lines as (
  select seq, concat(
    case seq % 20 when 13 then '{' when 14 then '[{' else concat('{"ts": ',
      case seq % 20 when 1 then '"soon"' when 2 then '-5' when 3 then 'null'
                    else cast(ts_us // 1000000 as varchar) end, ', ') end,
    case when seq % 20 = 16 then '' else concat('"src_ip": ',
      case seq % 20 when 4 then '17' when 5 then '"  "' else concat('"', src_ip, '"') end, ', ') end,
    '"domain": ', case seq % 20 when 6 then concat('"', repeat('x', 256), '"') when 7 then 'null'
                                else concat('"', domain, '"') end,
    ', "qtype": ', case seq % 20 when 8 then '""' else concat('"', qtype, '"') end,
    ', "length": ', case seq % 20 when 9 then 'true' when 10 then '-1' else cast(length(domain) as varchar) end,
    case when seq % 20 = 17 then '' else concat(', "nxdomain": ',
      case seq % 20 when 11 then 'null' when 12 then '"yes"' else case when nxdomain then 'true' else 'false' end end) end,
    case seq % 20 when 14 then '}]' when 15 then '' else '}' end) as value
  from dns_events
  union all
  select 10000000 + conv_id * 1000 + turn, text from conversations),
parsed as (
  select seq, value, case when json_valid(value) then cast(value as json) end as j
  from lines where regexp_matches(value, '\\S')),
typed as (
  select *, json_type(j) as kind, json_type(j, '$.ts') as k_ts, json_type(j, '$.src_ip') as k_ip,
         json_type(j, '$.domain') as k_domain, json_type(j, '$.qtype') as k_qtype,
         json_type(j, '$.length') as k_length, json_type(j, '$.nxdomain') as k_nx,
         json_extract_string(j, '$.src_ip') as ip, json_extract_string(j, '$.domain') as domain,
         json_extract_string(j, '$.qtype') as qtype
  from parsed),
checked as (
  select *, case
    when j is null then 'invalid JSON'
    when kind <> 'OBJECT' then concat('event is not a JSON object: ', case kind when 'ARRAY' then 'list'
         when 'VARCHAR' then 'str' when 'NULL' then 'NoneType' when 'BOOLEAN' then 'bool'
         when 'DOUBLE' then 'float' else 'int' end)
    when k_ts is null or k_ip is null or k_domain is null or k_qtype is null or k_length is null then
         concat('missing required field(s): ', concat_ws(', ', case when k_ts is null then 'ts' end,
           case when k_ip is null then 'src_ip' end, case when k_domain is null then 'domain' end,
           case when k_qtype is null then 'qtype' end, case when k_length is null then 'length' end))
    when k_ts not in ('UBIGINT', 'BIGINT', 'DOUBLE') then concat('ts must be a number, got ',
         case k_ts when 'VARCHAR' then 'str' when 'NULL' then 'NoneType' when 'BOOLEAN' then 'bool'
                   when 'ARRAY' then 'list' else 'dict' end)
    when cast(json_extract_string(j, '$.ts') as double) < 0 then
         concat('ts must be non-negative, got ', cast(json_extract(j, '$.ts') as varchar))
    when k_ip <> 'VARCHAR' or trim(ip) = '' then
         concat('src_ip must be a non-empty string, got ', cast(json_extract(j, '$.src_ip') as varchar))
    when k_domain <> 'VARCHAR' or trim(domain) = '' then
         concat('domain must be a non-empty string, got ', cast(json_extract(j, '$.domain') as varchar))
    when length(domain) > 255 then concat('domain exceeds max DNS name length: ', length(domain), ' chars')
    when k_qtype <> 'VARCHAR' or qtype = '' then
         concat('qtype must be a non-empty string, got ', cast(json_extract(j, '$.qtype') as varchar))
    when k_length not in ('UBIGINT', 'BIGINT', 'DOUBLE') or try_cast(json_extract_string(j, '$.length') as double) < 0 then
         concat('length must be a non-negative number, got ', cast(json_extract(j, '$.length') as varchar))
    when k_nx is not null and k_nx <> 'BOOLEAN' then
         concat('nxdomain must be a boolean if present, got ', cast(json_extract(j, '$.nxdomain') as varchar))
    end as reason
  from typed)"""

MESSAGES = EVENTS + """,
asked as (
  select seq * 2 as seq, ts_us, src_ip, domain, 53000 + seq % 7 as port, seq % 3 as dns_id,
         case qtype when 'NULL' then '4711' else qtype end as qtype from dns_events),
answered as (
  select seq * 2 + 1 as seq, ts_us + 20000 as ts_us, src_ip, 53000 + seq % 7 as port, seq % 3 as dns_id,
         nxdomain from dns_events where qtype <> 'CNAME')"""


def _matched(condition: str) -> str:
    return f"""with {MESSAGES}
select q.seq, q.src_ip, q.domain, q.qtype, cast(length(q.domain) as double) as length,
       coalesce(arg_max(r.nxdomain, r.seq), false) as nxdomain, q.ts_us
from asked q left join answered r
  on q.dns_id = r.dns_id and q.src_ip = r.src_ip and q.port = r.port {condition}
group by q.seq, q.src_ip, q.domain, q.qtype, q.ts_us"""


RULES = f"""{HOSTS},
names as (select distinct domain, string_split(domain, '.') as l from hosts),
tails as (select domain, l[-1] as last1, concat(l[-2], '.', l[-1]) as last2 from names),
rules as (
  select last1 as rule, 'rule' as kind from tails
  union select last2, 'rule' from tails where last2 = 'example.net'
  union select concat('*.', last2), 'rule' from tails where last2 = 'example.org'
  union select domain, 'exception' from tails where last2 = 'example.org' and domain like 'www.%'
  union select unnest([{", ".join(f"'{s}'" for s in EXTRA_SUFFIXES)}]), 'rule')"""
REGISTRABLE = RULES + """,
candidates as (
  select domain, l, len(l) as n_labels, n, array_to_string(l[len(l) - n + 1:], '.') as exact,
         concat('*.', array_to_string(l[len(l) - n + 2:], '.')) as wild
  from (select domain, l, unnest(range(1, len(l) + 1)) as n from names)),
lengths as (
  select domain, l, n_labels, greatest(1, max(case
    when exists (select 1 from rules r where r.kind = 'exception' and r.rule = exact) then n - 1
    when exists (select 1 from rules r where r.kind = 'rule' and r.rule = exact) then n
    when n >= 2 and exists (select 1 from rules r where r.kind = 'rule' and r.rule = wild) then n else 1 end)) as k
  from candidates group by domain, l, n_labels),
registrable as (
  select domain, cast(k as integer) as suffix_length, l[n_labels - least(k, n_labels - 1)] as registrable_label,
         array_to_string(l[n_labels - least(k, n_labels - 1):], '.') as registrable_domain
  from lengths)"""

TOKENS = "tokens as (select distinct unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) as word from documents)"
LABELS = f"""{HOSTS}, {TOKENS},
labels_in as (select unnest(string_split(domain, '.')) as label from hosts union select word from tokens)"""
BIGRAMS = """pairs as (
  select substr(word, i, 2) as bigram, count(*) as n
  from (select word, unnest(range(1, length(word))) as i from tokens where length(word) >= 2) group by 1),
model as (select bigram, n / (select sum(n) from pairs) as prob from pairs)"""


def _basic(source: str, label: str) -> str:
    """Word-free features of a column."""
    return f"""chars as (select {label} as label, unnest(string_split({label}, '')) as ch from {source} where {label} <> ''),
char_counts as (select label, ch, count(*) as c from chars group by label, ch),
char_entropy as (
  select label, -sum((c / length(label)) * log2(c / length(label))) as entropy from char_counts group by label),
basic as (
  select s.{label} as label, cast(length(s.{label}) as double) as length, round(coalesce(entropy, 0.0), 6) as entropy,
    round(length(regexp_replace(s.{label}, '[^\\p{{Nd}}]', '', 'g')) / greatest(length(s.{label}), 1), 6) as digit_ratio,
    round(length(regexp_replace(s.{label}, '[^aeiou]', '', 'g')) / greatest(
      length(regexp_replace(s.{label}, '[^\\p{{L}}]|[aeiou]', '', 'g')), 1), 6) as vowel_consonant_ratio,
    cast(coalesce(list_max(list_transform(regexp_split_to_array(s.{label}, '[^\\p{{L}}]|[aeiou]'),
      lambda r: length(r))), 0) as double) as max_consonant_run,
    round(length(regexp_replace(lower(s.{label}), '[^0-9a-f]', '', 'g')) / greatest(length(s.{label}), 1), 6) as hex_char_ratio
  from {source} s left join char_entropy e on e.label = s.{label})"""


def _coverage(source: str, label: str, shortest: int) -> str:
    return f"""spans as (
  select {label} as label, i, k from (
    select {label}, i, unnest(range(3, least(12, length({label}) - i + 1) + 1)) as k
    from (select {label}, unnest(range(1, length({label}) - 1)) as i from {source}))
  where substr({label}, i, k) in (select word from tokens where length(word) >= {shortest})),
covered as (select label, count(distinct p) as n from (select label, unnest(range(i, i + k)) as p from spans) group by label),
coverage as (
  select s.{label} as label, round(coalesce(n, 0) / greatest(length(s.{label}), 1), 6) as dict_word_ratio
  from {source} s left join covered c on c.label = s.{label})"""


def _bigram_score(source: str, label: str) -> str:
    return f"""grams as (
  select {label} as label, substr({label}, i, 2) as bigram
  from (select {label}, unnest(range(1, length({label}))) as i from {source})),
gram_scores as (select label, avg(ln(coalesce(prob, 1e-6))) as s from grams left join model using (bigram) group by label),
scores as (select x.{label} as label, round(coalesce(s, 0.0), 6) as ngram_score
  from {source} x left join gram_scores g on g.label = x.{label})"""


POPULAR = """, popular as (select domain from hosts group by domain order by count(*) desc, domain limit 25),
allowed as (select distinct registrable_domain from registrable join popular using (domain))"""
NAMED = EVENTS + ", " + REGISTRABLE.removeprefix(HOSTS + ",\n") + POPULAR

ALERTS = PER_EVENT + """,
decided as (
  select f.*, e.ts, e.ts_us, e.src_ip, -(0.25 - f.query_rate / 10 - x.txt / 2) as score
  from full_features f join dns_events e using (seq)
  join (select seq, avg(case when qtype = 'TXT' then 1.0 else 0.0 end) as txt from frames group by seq) x using (seq)
  where f.query_rate >= 2),
alerts as (
  select *, ts as timestamp, src_ip as flow_id, 'DNS_TUNNELLING' as threat_class, least(score, 1.0) as confidence,
    case when least(score, 1.0) >= 0.85 then 'CRITICAL' when least(score, 1.0) >= 0.6 then 'HIGH'
         when least(score, 1.0) >= 0.3 then 'MEDIUM' else 'LOW' end as severity
  from decided where score > 0)"""

SCORED = """scored as (
  select doc_id, lang, source, l.quality as label,
         ((n_chars * 37 + doc_id * 101) % 700 + l.quality * 300) / 1000 as p
  from documents join labels l using (doc_id)),
judged as (select *, case when p >= 0.5 then 1 else 0 end as predicted from scored)"""
CONFUSION = SCORED + """,
cm as (
  select count(*) filter (where label = 0 and predicted = 0) as tn, count(*) filter (where label = 0 and predicted = 1) as fp,
         count(*) filter (where label = 1 and predicted = 0) as fn, count(*) filter (where label = 1 and predicted = 1) as tp
  from judged)"""
CURVE = SCORED + """,
thresholds as (select distinct p as threshold from scored),
curve as (
  select threshold, count(*) as flagged, sum(label) as tp
  from thresholds join scored on p >= threshold group by threshold),
points as (
  select threshold, tp / flagged as precision, tp / (select sum(label) from scored) as recall from curve)"""

GENERATED = """generated as (
  select distinct concat(case when source in ('src0', 'src1') then substr(md5(text), 1, 12)
    else translate(substr(md5(text), 1, 14), '0123456789', 'ghijklmnop') end, '.net') as domain, source as family
  from documents)"""
DOMAINS = f"""{HOSTS}, {TOKENS}, {GENERATED},
benign as (select concat(word, '.com') as domain from tokens union select domain from hosts),
labelled as (select domain, 1 as label, family from generated union all select domain, 0, 'benign' from benign)"""
SESSIONS = EVENTS + """,
tools as (
  select seq, domain, qtype, length, nxdomain, list_extract(['normal', 'dns2tcp', 'dnscapy', 'iodine', 'tuns'],
    cast(cast(substr(src_ip, 8) as bigint) % 5 + 1 as integer)) as tool from dns_events),
ranked as (
  select *, row_number() over (partition by tool order by md5(concat(seq, ':42'))) as r, count(*) over (partition by tool) as n,
         case when tool = 'normal' then 12 else 40 end as k from tools),
chunks as (select *, (r - 1) // k as session from ranked where ((r - 1) // k + 1) * k <= n),
""" + _features("tool, session", "select tool, session, domain, qtype, length, nxdomain from chunks")



def _draw(low: str, high: str, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', 42, {', '.join(parts)})), 1, 8))::bigint % ({high} - {low} + 1) + {low})"


BOOTSTRAP = SESSIONS.split("ranked as (")[0] + f"""
pool as (select *, row_number() over (order by md5(concat(seq, ':42'))) as place, count(*) over () as n
  from tools where tool = 'normal'),
plans as (
  select s as session, n, least({_draw('2', '5', 's', "'f'")}, n) as favourites, {_draw('8', '20', 's', "'n'")} as size,
    {_draw('0', 'n - 1', 's', "'start'")} as start, {_draw('1', 'greatest((n - 1) // 5, 1)', 's', "'step'")} as step
  from (select unnest(range(416)) as s), (select max(n) as n from pool)),
draws as (select *, unnest(range(1, size + 1)) as draw from plans),
places as (
  select session, (start + {_draw('0', 'favourites - 1', 'session', 'draw', "'pick'")} * step) % n + 1 as place from draws),
""" + _features("session", "select session, domain, qtype, length, nxdomain from places join pool using (place)")

ORACLES: dict[str, str] = {
    "event_validation": f"""with {LINES}
        select seq, cast(json_extract_string(j, '$.ts') as double) as ts, ip as src_ip, domain, qtype,
               cast(json_extract_string(j, '$.length') as double) as length,
               coalesce(cast(json_extract_string(j, '$.nxdomain') as boolean), false) as nxdomain
        from checked where reason is null""",
    "event_rejects": f"with {LINES} select seq, value as raw, reason from checked where reason is not null",
    "query_response_match": _matched(""),
    "query_response_interval": _matched(f"and r.ts_us between q.ts_us and q.ts_us + {12 * HOUR}"),
    "window_features": f"with {PER_EVENT} {PER_EVENT_ROWS} where query_rate >= 5",
    "window_features_all": f"with {PER_EVENT} {PER_EVENT_ROWS}",
    "hopping_features": f"with {PER_SLIDE} select * from full_features",
    "window_features_at": f"""with {PER_SLIDE},
        probes as (select src_ip, min(ts_us) + {24 * HOUR} as ts_us from dns_events group by src_ip)
        select p.src_ip, p.ts_us, coalesce(query_rate, 0) as query_rate, coalesce(unique_subdomains, 0) as unique_subdomains,
          coalesce(avg_query_len, 0) as avg_query_len, coalesce(txt_ratio, 0) as txt_ratio,
          coalesce(nxdomain_rate, 0) as nxdomain_rate, coalesce(non_a_ratio, 0) as non_a_ratio,
          coalesce(record_type_entropy, 0) as record_type_entropy
        from probes p left join full_features f on f.src_ip = p.src_ip and f.slide = p.ts_us // {HOUR}""",
    "window_unique_sketch": f"""with {EVENTS},
        per_bucket as (select src_ip, bucket, count(distinct domain) as n from dns_events group by src_ip, bucket),
        largest as (select src_ip, slide, max(n) as n from (
          select src_ip, bucket + unnest(range(0, 12)) as slide, n from per_bucket) group by src_ip, slide),
        names as (select src_ip, slide, count(distinct domain) as c from (
          select src_ip, bucket + unnest(range(0, 12)) as slide, domain from dns_events) group by src_ip, slide)
        select src_ip, slide, n > 1 as is_estimate, cast(c as double) as unique_subdomains
        from names join largest using (src_ip, slide)""",
    "idle_keys": f"""with {EVENTS}
        select src_ip, max(ts_us) as last_seen_us, max(ts_us) < (select max(ts_us) from dns_events) - {24 * HOUR} as idle
        from dns_events group by src_ip""",
    "suffix_rules": f"with {RULES} select rule, kind from rules",
    "registrable_domain": f"with {REGISTRABLE} select * from registrable",
    "lexical_basic": f"with {LABELS}, {_basic('labels_in', 'label')} select * from basic",
    "bigram_model": f"with {TOKENS}, {BIGRAMS} select bigram, round(prob, 9) as prob from model",
    "bigram_score": f"with {LABELS}, {BIGRAMS}, {_bigram_score('labels_in', 'label')} select * from scores",
    "dictionary_coverage": f"with {LABELS}, {_coverage('labels_in', 'label', 3)} select * from coverage",
    "lexical_features": f"""with {REGISTRABLE}, {TOKENS}, {BIGRAMS},
        reg_labels as (select distinct registrable_label as name from registrable),
        {_basic('reg_labels', 'name')}, {_bigram_score('reg_labels', 'name')}, {_coverage('reg_labels', 'name', 3)}
        select domain, registrable_label, length, entropy, digit_ratio, vowel_consonant_ratio, max_consonant_run,
               ngram_score, dict_word_ratio, hex_char_ratio
        from registrable r join basic b on b.label = registrable_label join scores s on s.label = registrable_label
        join coverage c on c.label = registrable_label""",
    "allowlist_filter": f"""with {NAMED}
        select seq, src_ip, domain, registrable_domain from dns_events join registrable using (domain)
        where registrable_domain not in (select registrable_domain from allowed)""",
    "allowlist_coverage": f"""with {NAMED}
        select qtype, count(*) as n, count(*) filter (where a.registrable_domain is not null) as n_listed,
               round(avg(case when a.registrable_domain is not null then 1.0 else 0.0 end), 6) as share
        from dns_events join registrable r using (domain) left join allowed a on a.registrable_domain = r.registrable_domain
        group by qtype""",
    "alert_envelope": f"""with {ALERTS}
        select timestamp, flow_id, threat_class, severity, round(confidence, 6) as confidence, seq,
               cast(query_rate as double) as query_rate, unique_subdomains, avg_query_len, txt_ratio, nxdomain_rate,
               non_a_ratio, record_type_entropy, true as no_lexical_evidence, {_alert_id("'DNS_TUNNELLING'", "src_ip")}
        from alerts""",
    "dga_alert_envelope": f"""with {EVENTS}, names as (select distinct domain from dns_events), {_basic('names', 'domain')},
        scored as (select e.*, b.length as n_chars, entropy,
          least(length(regexp_replace(domain, '[^0-9a-f]', '', 'g')) / length(domain) * 1.5
                + length(regexp_replace(domain, '[^0-9]', '', 'g')) / length(domain), 1.0) as prob
          from dns_events e join basic b on b.label = e.domain)
        select seq, ts as timestamp, domain as flow_id, 'DGA' as threat_class,
          case when prob >= 0.85 then 'CRITICAL' when prob >= 0.6 then 'HIGH' when prob >= 0.3 then 'MEDIUM' else 'LOW' end as severity,
          round(prob, 6) as confidence, src_ip, entropy, n_chars as length, true as no_window_evidence,
          {_alert_id("'DGA'", "domain")}
        from scored where prob > 0.5""",
    "severity_counts": f"with {ALERTS} select severity, count(*) as n from alerts group by severity",
    "class_counts": f"with {ALERTS} select threat_class, count(*) as n from alerts group by threat_class",
    "alert_log": f"""with {ALERTS} select ts_us as time_us, threat_class, severity, flow_id,
        round(confidence, 6) as confidence from alerts""",
    "first_alert_per_flow": f"""with {ALERTS}
        select flow_id, min(seq) as seq, arg_min(timestamp, seq) as timestamp, arg_min(severity, seq) as severity,
               round(arg_min(confidence, seq), 6) as confidence from alerts group by flow_id""",
    "alert_cooldown": f"""with recursive {EVENTS},
        raw as (select src_ip as flow_id, ts_us, seq, row_number() over (partition by src_ip order by seq) as r
                from dns_events),
        chain as (
          select flow_id, ts_us, seq from raw where r = 1
          union all
          select x.flow_id, x.ts_us, x.seq from (
            select n.*, row_number() over (partition by n.flow_id order by n.seq) as k
            from chain c join raw n on n.flow_id = c.flow_id and n.ts_us >= c.ts_us + {48 * HOUR} and n.seq > c.seq) x
          where k = 1)
        select 'DNS_TUNNELLING' as threat_class, flow_id, ts_us, seq from chain""",
    "confusion": f"with {CONFUSION} select tn, fp, fn, tp from cm",
    "class_report": f"""with {CONFUSION},
        parts as (
          select '0' as class, tn / (tn + fn) as precision, tn / (tn + fp) as recall, tn + fp as support from cm
          union all select '1', tp / (tp + fp), tp / (tp + fn), tp + fn from cm),
        per_class as (select *, 2 * precision * recall / (precision + recall) as f1 from parts),
        report as (
          select class, precision, recall, f1, support from per_class
          union all select 'accuracy', (tn + tp) / (tn + fp + fn + tp), (tn + tp) / (tn + fp + fn + tp),
                           (tn + tp) / (tn + fp + fn + tp), tn + fp + fn + tp from cm
          union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from per_class
          union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                           sum(f1 * support) / sum(support), sum(support) from per_class)
        select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
               cast(support as bigint) as support from report""",
    "roc_auc": f"""with {SCORED}
        select round(avg(case when a.p > b.p then 1.0 when a.p = b.p then 0.5 else 0.0 end), 6) as auc
        from scored a join scored b on a.label = 1 and b.label = 0""",
    "brier": f"with {SCORED} select round(avg((p - label) * (p - label)), 6) as brier from scored",
    "pr_curve": f"""with {CURVE}
        select threshold, round(precision, 6) as precision, round(recall, 6) as recall from points
        union all select null, 1.0, 0.0""",
    "severity_tiers": f"""with {SCORED}, cuts as (select unnest([0.3, 0.6, 0.85])::double as cut)
        select cut, round(coalesce(sum(label) filter (where p >= cut) / count(*) filter (where p >= cut), 1.0), 6) as precision,
               round(coalesce(sum(label) filter (where p >= cut), 0) / sum(label), 6) as recall_at_or_above,
               count(*) filter (where p >= cut) as n_flagged
        from cuts cross join scored group by cut""",
    "operating_points": f"""with {CURVE},
        targets as (select unnest([0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001])::double as target),
        ranked as (select target, threshold, precision, recall,
          row_number() over (partition by target order by recall desc, threshold) as k
          from targets join points on 1 - precision <= target)
        select target as max_false_discovery_rate, threshold, round(precision, 6) as precision, round(recall, 6) as recall
        from targets left join (select * from ranked where k = 1) using (target)""",
    "reliability": f"""with {SCORED}
        select cast(least(floor(p * 10) + 1, 10) as bigint) as bin, count(*) as n, round(avg(p), 6) as mean_predicted,
               round(avg(label), 6) as observed from scored group by 1""",
    "group_recall": f"with {SCORED} select source, round(avg(predicted), 6) as recall, count(*) as n from judged where label = 1 group by source",
    "specificity": f"""with {SCORED} select count(*) as n, round(avg(predicted), 6) as fp_rate,
        round(1 - avg(predicted), 6) as specificity from judged where label = 0""",
    "nearest_rank_latency": """with s as (select list(value order by value) as v, count(*) as n from events)
        select n, v[cast(least(floor(0.5 * n), n - 1) + 1 as bigint)] as p50, v[cast(least(floor(0.95 * n), n - 1) + 1 as bigint)] as p95,
               v[cast(least(floor(0.99 * n), n - 1) + 1 as bigint)] as p99 from s""",
    "nearest_rank_by_group": """with s as (select event_type, list(value order by value) as v, count(*) as n from events group by event_type)
        select event_type, n, v[cast(least(floor(0.5 * n), n - 1) + 1 as bigint)] as p50, v[cast(least(floor(0.95 * n), n - 1) + 1 as bigint)] as p95,
               v[cast(least(floor(0.99 * n), n - 1) + 1 as bigint)] as p99 from s""",
    "column_medians": """
        select 'l_quantity' as "column", round(median(l_quantity)::double, 6) as median from lineitem
        union all select 'l_extendedprice', round(median(l_extendedprice)::double, 6) from lineitem
        union all select 'l_discount', round(median(l_discount)::double, 6) from lineitem""",
    "column_quantile": "select round(quantile_cont(value, 0.02), 6) as quantile from events",
    "describe_columns": f"""with {EVENTS}
        select 'length' as "column", round(avg(length), 6) as mean, min(length) as min, max(length) as max from dns_events
        union all select 'value', round(avg(value), 6), round(min(value), 6), round(max(value), 6) from dns_events""",
    "throughput": f"""with {EVENTS}
        select count(*) as n, round((max(ts_us) - min(ts_us)) / 1e6, 6) as elapsed_s,
               round(count(*) / ((max(ts_us) - min(ts_us)) / 1e6), 6) as per_second, round(avg(value), 6) as mean_value
        from dns_events""",
    "domain_union": f"""with {DOMAINS}
        select lower(trim(domain)) as domain from hosts union select domain from generated union select domain from benign""",
    "family_cap": f"""with {DOMAINS}
        select domain, family from (select *, row_number() over (
          partition by family order by md5(concat(domain, ':42')), domain) as r from generated) where r <= 40""",
    "balanced_set": f"""with {DOMAINS}
        select domain, 1 as label, family from generated
        union all
        select domain, 0, 'benign' from (select domain, row_number() over (order by md5(concat(domain, ':42'))) as r from benign)
        where r <= (select count(*) from generated)""",
    "shuffled_set": f"""with {DOMAINS}
        select domain, row_number() over (order by md5(concat(domain, ':42'))) as position
        from (select distinct domain from labelled)""",
    "stratified_split": f"""with {DOMAINS}
        select domain, label, family, r <= ceil(n * 0.2) as is_test from (
          select *, row_number() over (partition by label order by md5(concat(domain, ':42'))) as r,
                 count(*) over (partition by label) as n from labelled)""",
    "leave_one_out_split": f"""with {DOMAINS},
        held as (select domain from (select domain, row_number() over (order by md5(concat(domain, ':1'))) as r,
                 count(*) over () as n from benign) where r <= round(n * 0.3))
        select domain, label, family, 'train' as part from labelled
        where family <> 'src1' and domain not in (select domain from held)
        union all select domain, label, family, 'test' from labelled where family = 'src1'
        union all select domain, 0, 'benign', 'test' from held""",
    "family_list": f"with {DOMAINS} select distinct family from generated",
    "label_family_counts": f"with {DOMAINS} select label, family, count(*) as n from labelled group by label, family",
    "fixed_sessions": f"""with {SESSIONS}
        select tool, session, query_rate, unique_subdomains, avg_query_len, txt_ratio, 0.0::double as nxdomain_rate, non_a_ratio,
               record_type_entropy, case when tool = 'normal' then 'normal' else 'tunnel' end as label from full_features""",
    "tool_signatures": f"""with {SESSIONS},
        exact as (select tool, session, avg(length) as avg_query_len, avg(case when qtype = 'TXT' then 1.0 else 0.0 end) as txt_ratio,
          avg(case when qtype <> 'A' then 1.0 else 0.0 end) as non_a_ratio from frames group by tool, session)
        select case when tool = 'normal' then 'normal' else 'tunnel' end as label, tool, round(avg(avg_query_len), 6) as avg_query_len,
               round(avg(txt_ratio), 6) as txt_ratio, round(avg(non_a_ratio), 6) as non_a_ratio,
               round(avg(h), 6) as record_type_entropy
        from exact join entropies using (tool, session) group by tool""",
    "bootstrap_sessions": f"""with {BOOTSTRAP}
        select session, query_rate, unique_subdomains, avg_query_len, txt_ratio, 0.0::double as nxdomain_rate, non_a_ratio,
               record_type_entropy, 'normal' as label, 'normal_realistic' as tool from full_features""",
    "event_log_scan": f"""with {LINES}
        select cast(json_extract_string(j, '$.ts') as double) as ts, ip as src_ip, domain, qtype,
               cast(json_extract_string(j, '$.length') as double) as length,
               coalesce(cast(json_extract_string(j, '$.nxdomain') as boolean), false) as nxdomain
        from checked where reason is null""",
    "run_counters": f"""with {LINES}
        select count(*) as lines, count(reason) as rejected, count(*) - count(reason) as events from checked""",
    "message_filter": _matched("").replace("from asked q left join answered r", """from (
          select * from asked where seq % 11 <> 0 and seq % 13 <> 0 and seq % 17 <> 0 and seq % 19 <> 0 and seq % 23 <> 0) q
        left join (select * from answered where seq % 11 <> 0 and seq % 13 <> 0) r"""),
    "ranked_list": f"""with {HOSTS}
        select rank, domain from (
          select row_number() over (order by count(*) desc, domain) as rank, domain from hosts group by domain) where rank <= 10""",
}
ORACLES["report_sink"] = ORACLES["class_report"]

# Events where failing queries ask for random-looking names, with the features after each of them.
THREATS = PER_EVENT.replace("dns_events as (", "plain_events as (", 1).replace(", frames as (", """,
renamed as (
  select * exclude (domain, length), case when nxdomain then concat(substr(md5(cast(seq as varchar)), 1, 12), '.net')
    else domain end as domain from plain_events),
dns_events as (select *, cast(length(domain) as double) as length from renamed), frames as (""", 1)


def _expected_path(n: int) -> str:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 2:
        return "1.0" if n == 2 else "0.0"
    return f"(2 * (ln({n - 1}) + 0.57721566490153286) - 2 * {n - 1}.0 / {n})"


FIXED = THREATS + f""",
exact as (
  select seq, avg(length) as len, avg(case when qtype = 'TXT' then 1.0 else 0.0 end) as txt from frames group by seq),
decided as (
  select f.seq, e.src_ip, e.ts, e.ts_us, f.query_rate, 0.48 - pow(2, -((
      case when f.query_rate <= 6 then 1 + {_expected_path(6)} else 2 end
      + case when x.len <= 15.5 then 1 + {_expected_path(5)} else 1 + {_expected_path(3)} end) / 2) / {_expected_path(8)}) as decision
  from full_features f join dns_events e using (seq) join exact x using (seq))"""
ORACLES["fixed_forest_scores"] = f"with {FIXED} select seq, src_ip, round(decision, 9) as decision from decided"

_NAMES = REGISTRABLE.split(HOSTS, 1)[1].lstrip(", \n")
_DETECTED = f"""with recursive {FIXED}, {_NAMES},
labels as (
  select domain, registrable_label as label from registrable
  union select domain, split_part(domain, '.', 1) from dns_events where nxdomain),
scored as (
  select domain, least(0.75 * length(regexp_replace(label, '[^0-9a-f]', '', 'g')) / length(label)
    + length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label), 1.0) as prob from labels),
raw as (
  select seq, ts, ts_us, domain as flow_id, 'DGA' as threat_class, prob as confidence
  from dns_events join scored using (domain) where prob > 0.5
  union all
  select seq, ts, ts_us, src_ip, 'DNS_TUNNELLING', least(-decision, 1.0) from decided where query_rate >= 5 and decision < 0),
placed as (select *, row_number() over (partition by threat_class, flow_id order by ts_us, seq) as r from raw),
chain as (
  select threat_class, flow_id, ts_us, r from placed where r = 1
  union all
  select threat_class, flow_id, ts_us, r from (
    select n.*, row_number() over (partition by n.threat_class, n.flow_id order by n.r) as k
    from chain c join placed n on n.flow_id = c.flow_id and n.threat_class = c.threat_class
      and n.ts_us >= c.ts_us + {24 * HOUR} and n.r > c.r) where k = 1)
select COLUMNS, flow_id, threat_class, round(confidence, 9) as confidence, ts as timestamp,
  case when confidence >= 0.85 then 'CRITICAL' when confidence >= 0.6 then 'HIGH' when confidence >= 0.3 then 'MEDIUM'
       else 'LOW' end as severity
from chain join placed using (threat_class, flow_id, r)"""
ORACLES["detect_fixed_batch"] = _DETECTED.replace("COLUMNS, ", "seq, ")
ORACLES["detect_fixed_stream"] = _DETECTED.replace("COLUMNS, ", "")

ORACLES["rejected_lines"] = f"""with {LINES}
select (select count(*) from lines l where l.seq <= c.seq)::bigint as line, translate(value, chr(10) || chr(13), '  ') as raw, reason from checked c where reason is not null"""
ORACLES["late_events"] = f"""with {EVENTS},
span as (select min(ts_us) as low, max(ts_us) - min(ts_us) + 1 as width from dns_events),
placed as (
  select seq, src_ip, ts_us, ((ts_us - low) * 8 // width)::bigint as own from dns_events, span),
arrived as (
  select seq, src_ip, ts_us, case when seq % 7 = 3 then least(own + seq % 5, 7) else own end as batch from placed),
newest as (select src_ip, batch, max(ts_us) as newest_us from arrived group by src_ip, batch),
reached as (
  select a.seq, a.batch, a.ts_us, max(n.newest_us) as reached_us from arrived a left join newest n on n.src_ip = a.src_ip and n.batch < a.batch group by all),
marked as (select seq, batch, coalesce(reached_us - ts_us > 24 * {HOUR}, false) as late from reached)
select batch, count(*) as events, count(*) filter (late) as late, coalesce(sum(seq) filter (late), 0)::bigint as late_seqs
from marked group by batch"""

_FOREST_FEATURES = ("query_rate", "unique_subdomains", "avg_query_len", "txt_ratio", "nxdomain_rate", "non_a_ratio", "record_type_entropy")
_LOWS, _HIGHS = (", ".join(f"{f}(x[{i + 1}]) over together" for i in range(7)) for f in ("min", "max"))
ORACLES["forest_nodes"] = f"""with recursive {PER_EVENT},
sampled as (
  select tree, seq, [{", ".join(f"{f}::double" for f in _FOREST_FEATURES)}] as x
  from (select *, row_number() over (
          partition by tree order by md5(concat(tree, '-', seq, ':forest')), concat(tree, '-', seq)) as r
        from full_features, range(10) as trees(tree))
  where r <= 64),
grown as (
  select tree, seq, x, 0 as depth, 0::bigint as node, true as is_open from sampled
  union all
  select tree, seq, x, depth + 1, case when x[f + 1] > cut then 2 * node + 2 else 2 * node + 1 end, true
  from (select *, case when low[f + 1] + v * (high[f + 1] - low[f + 1]) < high[f + 1] then low[f + 1] + v * (high[f + 1] - low[f + 1])
                       else low[f + 1] end as cut
        from (select *, can[floor(u * len(can))::int + 1] as f
              from (select *, list_filter(range(7), lambda i: high[i + 1] > low[i + 1]) as can,
                      ('0x' || substr(md5(concat('42:', tree, ':', node, ':1')), 1, 13))::bigint / 4503599627370496.0::double as u,
                      ('0x' || substr(md5(concat('42:', tree, ':', node, ':2')), 1, 13))::bigint / 4503599627370496.0::double as v
                    from (select *, [{_LOWS}] as low, [{_HIGHS}] as high from grown where depth < 6
                          window together as (partition by tree, node)))
              where len(can) > 0))),
nodes as (
  select tree, node, depth, count(*) as size, [{", ".join(f"min(x[{i + 1}])" for i in range(7))}] as low,
    [{", ".join(f"max(x[{i + 1}])" for i in range(7))}] as high
  from grown group by tree, node, depth),
drawn as (
  select *, list_filter(range(7), lambda i: high[i + 1] > low[i + 1]) as can,
    ('0x' || substr(md5(concat('42:', tree, ':', node, ':1')), 1, 13))::bigint / 4503599627370496.0::double as u,
    ('0x' || substr(md5(concat('42:', tree, ':', node, ':2')), 1, 13))::bigint / 4503599627370496.0::double as v from nodes),
split as (
  select *, depth < 6 and len(can) > 0 as splits, can[floor(u * len(can))::int + 1] as f from drawn),
placed as (select *, low[f + 1] + v * (high[f + 1] - low[f + 1]) as at_v from split)
select tree::int as tree, node::int as node, case when splits then f else 0 end::int as feature,
  case when not splits then -1.0 when at_v < high[f + 1] then at_v else low[f + 1] end as threshold,
  case when splits then 2 * node + 1 else node end::int as left, case when splits then 2 * node + 2 else node end::int as right,
  depth::int as depth, size::int as size
from placed"""

ORACLES["nearest_rank_of_batches"] = ORACLES["nearest_rank_latency"]
ORACLES["plain_list_files"] = f"""with {HOSTS},
entries as (
  select 'domain' as kind, domain as entry from hosts where domain <> ''
  union all
  select 'word', word from (
    select distinct unnest(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{Nd}}]+)', 1)) as word from documents))
select kind, length(entry) as n_chars, count(*) as n, count(distinct entry) as n_different, min(entry) as first, max(entry) as last
from entries group by kind, length(entry)"""
_PATH = f"""0.48 - pow(2, -((case when RATE <= 6 then 1 + {_expected_path(6)} else 2 end
  + case when LEN <= 15.5 then 1 + {_expected_path(5)} else 1 + {_expected_path(3)} end) / 2) / {_expected_path(8)})"""
ORACLES["fixed_ablation"] = f"""with {FIXED},
own as (select query_rate, len from full_features join exact using (seq)),
middle as (select median(query_rate)::double as rate, median(len) as len from own),
flags as (
  select {_PATH.replace('RATE', 'o.query_rate').replace('LEN', 'o.len')} < 0 as base,
    {_PATH.replace('RATE', 'm.rate').replace('LEN', 'o.len')} < 0 as by_rate,
    {_PATH.replace('RATE', 'o.query_rate').replace('LEN', 'm.len')} < 0 as by_len
  from own o, middle m),
rates as (
  select count(*) as n, avg(base::int) as base, avg(by_rate::int) as by_rate, avg(by_len::int) as by_len from flags),
variants as (select unnest(['baseline', 'query_rate', 'unique_subdomains', 'avg_query_len', 'txt_ratio', 'nxdomain_rate', 'non_a_ratio',
  'record_type_entropy']) as variant),
chosen as (
  select variant, n, base, case variant when 'query_rate' then by_rate when 'avg_query_len' then by_len else base end as fp_rate
  from variants, rates)
select variant, n, round(fp_rate, 6) as fp_rate, round((fp_rate - base) * 100, 6) as delta_points from chosen"""


def _totals(name: str, *features: str) -> str:
    sums = ", ".join(f"sum(round({f} * 1000000)::bigint)::bigint as {f}" for f in features)
    return f"select length(label) as n_chars, count(*) as n, {sums} from ({ORACLES[name]}) group by length(label)"


ORACLES["lexical_totals"] = _totals(
    "lexical_basic", "length", "entropy", "digit_ratio", "vowel_consonant_ratio", "max_consonant_run", "hex_char_ratio")
ORACLES["bigram_totals"] = _totals("bigram_score", "ngram_score")
ORACLES["dictionary_totals"] = _totals("dictionary_coverage", "dict_word_ratio")
