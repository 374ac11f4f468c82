"""The registered queries in plain SQL, written from the definitions.

Detection rules and incidents are spelled out pairwise here (self joins and a
recursive closure), not with the windows the Spark jobs use.
"""

from __future__ import annotations

from catalog import tables as t
from logwarden.config import CONTAMINATION_SWEEP, NON_IDENTITIES, PRIVILEGE_KEYWORDS
from logwarden.operators.camouflage import FILLER, REALISTIC_COMBO, REPHRASINGS, ROBUSTNESS_CONDITIONS, STRATEGIES
from logwarden.operators.injection import DESCRIPTIONS, FOREIGN_NETWORKS, INSIDER_NETWORK, PROBED_NAMES
from logwarden.operators.prompts import NO_TECHNIQUE, PROMPT, TRAVEL_NOTE
from logwarden.operators.rules import RULES
from logwarden.operators.techniques import SIGNALS, TECHNIQUES
from logwarden.operators.triage import SCENARIOS

SPAN = {"brute": "interval 5 minute", "enum": "interval 10 minute", "travel": "interval 60 minute"}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def draw(n, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT % ({n}))"


def between(low: int, high: int, *parts: str) -> str:
    return f"({low} + {draw(high - low + 1, *parts)})"


def pick(values, *parts: str) -> str:
    return f"({listed(values)})[{draw(len(values), *parts)} + 1]"


KEY = ("seed", "scenario", "instance")
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"

# --- the rendered log and its events

RENDERED = """
b as (
  select *, event_id // 40 as blk,
    date_trunc('second', TIMESTAMP '2026-07-14'
      + to_microseconds((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 10)) as tm
  from events),
u as (
  select *,
    case when event_type in ('error', 'signup') and blk % 22 = 0 then 'u' || lpad(cast(blk % 50 as varchar), 2, '0')
         when event_type = 'error' and blk % 11 = 0 then
           ['root','test','guest','oracle','postgres','www-data','ftpuser','backup','deploy','support'][event_id % 10 + 1]
         else 'u' || lpad(cast(user_id % 50 as varchar), 2, '0') end as usr,
    case when blk % 11 = 0 then '203.0.113.' || (blk % 200 + 2)
         else '10.0.' || (user_id % 50) || '.' || (event_id % 5 + 2) end as ip
  from b),
m as materialized (
  select event_id, tm as ts,
    case event_type when 'view' then 'CRON'
      when 'purchase' then case when event_id % 17 = 0 then 'sudo' else 'systemd' end else 'sshd' end as process,
    cast(1000 + event_id % 30000 as integer) as pid,
    case event_type
      when 'error'  then 'Failed password for ' || usr || ' from ' || ip || ' port ' || (50000 + event_id % 15000) || ' ssh2'
      when 'signup' then 'Accepted password for ' || usr || ' from ' || ip || ' port ' || (50000 + event_id % 15000) || ' ssh2'
      when 'click'  then 'pam_unix(sshd:session): session opened for user ' || usr || ' by (uid=0)'
      when 'view'   then '(root) CMD (run-parts /etc/cron.hourly)'
      else case when event_id % 17 = 0 then 'user=' || usr || ' : COMMAND=/bin/su root'
                else 'Started Session ' || (event_id % 99 + 1) || ' of user ' || usr || '.' end end as message
  from u),
lines as materialized (
  select row_number() over (order by ts, event_id) as line_number,
    strftime(ts, '%b %d %H:%M:%S') || ' server1 ' || process || '[' || pid || ']: ' || message as value
  from m)"""


def parsed_ctes(source: str, name: str, keys: str = "") -> str:
    line = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([\w\-/.]+)(?:\[(\d+)\])?:\s+(.*)$"
    parts = ", ".join(
        f"regexp_extract(trim(value), '{line}', {i}) as g{i}" for i in range(1, 6)
    )
    return rf"""
{name}_cut as (select {keys} line_number, trim(value) as raw, {parts} from {source}
  where regexp_matches(trim(value), '{line}')),
{name} as materialized (
  select {keys} line_number,
    try_strptime('{t.YEAR} ' || regexp_replace(g1, '\s+', ' ', 'g'), '%Y %b %d %H:%M:%S') as "timestamp",
    g2 as host, g3 as process, nullif(g4, '') as pid, g5 as message, raw,
    coalesce(nullif(regexp_extract(g5, '(?i)\buser[= ]([\w\-]+)\b', 1), ''),
             nullif(regexp_extract(g5, 'for ([\w\-]+) from', 1), ''), 'unknown') as "user",
    nullif(regexp_extract(g5, '{IP}', 0), '') as source_ip,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(g5, '{IP}', '<IP>', 'g'),
      '\bport \d+\b', 'port <PORT>', 'g'), '\[\d+\]', '[<PID>]', 'g'), '\b\d+\b', '<NUM>', 'g') as template
  from {name}_cut)"""


def on(keys, a: str, b: str) -> str:
    return "".join(f"{a}.{k} = {b}.{k} and " for k in keys)


def detector_ctes(source: str, p: str, keys=()) -> str:
    """Travel, the three rules and their union for every run in ``keys``."""
    k = "".join(f"{c}, " for c in keys)
    ks = ", ".join([*keys, '"user"'])
    words = " or ".join(f"contains(lower(message), {q(w)})" for w in PRIVILEGE_KEYWORDS)
    return f"""
{p}fail as materialized (select {k} line_number, "timestamp" as tm, "user" as usr, source_ip as ip from {source}
  where contains(lower(message), 'failed password')),
{p}good as materialized (select {k} line_number, "timestamp" as tm, "user" as usr, source_ip as ip from {source}
  where contains(lower(message), 'accepted password')),
{p}trip as (select {k} line_number, tm, ip, lag(tm) over w as tm0, lag(ip) over w as ip0 from {p}good
  where ip is not null window w as (partition by {k} usr order by tm, line_number)),
{p}travel as materialized (select {k} line_number from {p}trip where tm - tm0 <= {SPAN['travel']}
  and split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2)
   <> split_part(ip0, '.', 1) || '.' || split_part(ip0, '.', 2)),
{p}burst as materialized (select {", ".join("a." + c for c in keys) + "," if keys else ""} a.usr, a.line_number, a.tm, max(f.tm) as until
  from {p}fail a join {p}fail f on {on(keys, "a", "f")} a.usr = f.usr and f.tm between a.tm and a.tm + {SPAN['brute']}
  group by all having count(*) >= 3),
{p}brute as materialized (
  select distinct {", ".join("f." + c for c in keys) + "," if keys else ""} f.line_number from {p}fail f join {p}burst a
    on {on(keys, "a", "f")} a.usr = f.usr and f.tm between a.tm and a.tm + {SPAN['brute']}
  union
  select distinct {", ".join("g." + c for c in keys) + "," if keys else ""} g.line_number from {p}good g join {p}burst a
    on {on(keys, "a", "g")} a.usr = g.usr and g.tm between a.until and a.until + {SPAN['brute']}),
{p}sweep as materialized (select {", ".join("a." + c for c in keys) + "," if keys else ""} a.ip, a.line_number, a.tm
  from {p}fail a join {p}fail f on {on(keys, "a", "f")} a.ip = f.ip and f.tm between a.tm and a.tm + {SPAN['enum']}
  group by all having count(distinct f.usr) >= 3),
{p}enum as materialized (
  select distinct {", ".join("f." + c for c in keys) + "," if keys else ""} f.line_number from {p}fail f join {p}sweep a
    on {on(keys, "a", "f")} a.ip = f.ip and f.tm between a.tm and a.tm + {SPAN['enum']}),
{p}priv as (select {k} line_number from {source} where {words}),
{p}claims as (
  select {k} line_number, 1 as ord, 'brute_force' as rule from {p}brute union all
  select {k} line_number, 2, 'enumeration' from {p}enum union all
  select {k} line_number, 3, 'privileged_command' from {p}priv),
{p}fired as materialized (select {k} line_number, string_agg(rule, ',' order by ord) as rules_fired
  from {p}claims group by all),
{p}found as materialized (
  select s.*, coalesce(f.rules_fired, '') as rules_fired, v.line_number is not null as impossible_travel
  from {source} s
  left join {p}fired f on {on(keys, "s", "f")} s.line_number = f.line_number
  left join {p}travel v on {on(keys, "s", "v")} s.line_number = v.line_number)"""


def identity(column: str) -> str:
    return f"case when lower(trim({column})) in ('', {', '.join(map(q, NON_IDENTITIES))}) then null else trim({column}) end"


def incident_ctes(source: str, flag: str, p: str, keys=(), by_ip: bool = True) -> str:
    """Pairwise links and their closure."""
    k = "".join(f"{c}, " for c in keys)
    ka = "".join(f"a.{c}, " for c in keys)
    kr = "".join(f"r.{c}, " for c in keys)
    link_ip = f"""
  union
  select {ka} a.line_number, b.line_number from {p}an a join {p}an b on {on(keys, "a", "b")} a.ip = b.ip
    and b.tm between a.tm - interval 30 minute and a.tm + interval 30 minute""" if by_ip else ""
    part = f"partition by {', '.join(keys)}" if keys else ""
    return f"""
{p}an as materialized (select {k} line_number, "timestamp" as tm, {identity('"user"')} as usr,
  {identity('source_ip')} as ip from {source} where {flag} and "timestamp" is not null),
{p}link({k} x, y) as materialized (
  select {ka} a.line_number, b.line_number from {p}an a join {p}an b on {on(keys, "a", "b")} a.usr = b.usr
    and b.tm between a.tm - interval 30 minute and a.tm + interval 30 minute{link_ip}),
{p}reach({k} x, y) as (
  select {k} line_number, line_number from {p}an
  union
  select {kr} r.x, e.y from {p}reach r join {p}link e on {on(keys, "e", "r")} e.x = r.y),
{p}root as (select {kr} r.x, min({{'tm': a.tm, 'line': a.line_number}}) as root
  from {p}reach r join {p}an a on {on(keys, "a", "r")} a.line_number = r.y group by all),
{p}id as materialized (select {k} x as line_number,
  cast(dense_rank() over ({part} order by root.tm, root.line) - 1 as bigint) as incident_id from {p}root)"""


RANK = "list_position(['none','low','medium','high'], severity)"
JUDGED = f"""
judged as materialized (
  select *, rules_fired <> '' or impossible_travel as is_anomaly,
    case when impossible_travel then 'high'
         when rules_fired = '' then 'none'
         when (line_number % 40) / 200.0::double >= 0.15 then 'high'
         when (line_number % 40) / 200.0::double >= 0.05 then 'medium' else 'low' end as severity
  from d_found)"""


def _technique_rows() -> str:
    rows = []
    for at, (i, n, tactic, words) in enumerate(TECHNIQUES):
        rows.append(f"({at}, {q(i)}, {q(n)}, {q(tactic)}, {listed(words)}, cast(null as varchar))")
    for at, (_, i, n, tactic, evidence) in enumerate(SIGNALS):
        rows.append(f"({len(TECHNIQUES) + at}, {q(i)}, {q(n)}, {q(tactic)}, cast([] as varchar[]), "
                    f"{q(evidence.format(least=3))})")
    return ",\n  ".join(rows)


TECHNIQUE_TABLE = f"""
tech(ord, technique_id, technique_name, tactic, words, evidence) as (values
  {_technique_rows()})"""

INCIDENTS = f"""
tagged as materialized (select j.*, i.incident_id from judged j join i_id i on j.line_number = i.line_number),
sig(incident_id, signal) as materialized (
  select distinct incident_id, 'impossible_travel' from tagged where impossible_travel
  union all
  select distinct incident_id, 'account_enumeration' from (
    select incident_id, source_ip from tagged where source_ip is not null
    group by all having count(distinct "user") >= 3)),
hit as (
  select g.incident_id, k.ord, min({{'tm': g.timestamp, 'line': g.line_number}}) as first
  from tagged g join tech k on len(list_filter(k.words, lambda w: contains(lower(g.message), w))) > 0 group by all
  union all
  select incident_id, case signal when 'impossible_travel' then {len(TECHNIQUES)} else {len(TECHNIQUES) + 1} end, null
  from sig),
itech as materialized (
  select h.incident_id, row_number() over (partition by h.incident_id order by h.first is null, h.first, h.ord) - 1 as position,
    k.technique_id, k.technique_name, k.tactic, k.evidence
  from hit h join tech k on h.ord = k.ord),
itech_list as (select incident_id, string_agg(technique_id, ',' order by position) as ids,
    string_agg(technique_name, ',' order by position) as names,
    string_agg('- ' || technique_id || ' (' || technique_name || ') - ' || tactic
      || coalesce(' [' || evidence || ']', ''), chr(10) order by position) as block
  from itech group by all),
inc0 as (
  select incident_id, list_sort(list_distinct(list("user"))) as users,
    coalesce(list_sort(list_distinct(list(source_ip) filter (where source_ip is not null))), []) as source_ips,
    coalesce(list_sort(list_distinct(list({identity('"user"')}) filter (where {identity('"user"')} is not null))), []) as real_users,
    min("timestamp") as "start", max("timestamp") as "end", count(*) as event_count, bool_or(impossible_travel) as travelled,
    ['none','low','medium','high'][max({RANK})] as severity
  from tagged group by all),
inc as materialized (
  select o.*, coalesce(l.ids, '') as techniques, coalesce(l.names, '') as technique_names,
    coalesce(l.block, {q(NO_TECHNIQUE)}) as technique_block,
    severity = 'high' or event_count >= 2 as notable,
    event_count || ' events | users: '
      || case when len(real_users) = 0 then 'n/a' else array_to_string(real_users[1:3], ', ')
         || case when len(real_users) > 3 then '...' else '' end end
      || ' | source IPs: '
      || case when len(source_ips) = 0 then 'n/a' else array_to_string(source_ips[1:3], ', ')
         || case when len(source_ips) > 3 then '...' else '' end end as summary
  from inc0 o left join itech_list l on o.incident_id = l.incident_id)"""

LOG = f"{RENDERED},{parsed_ctes('lines', 'parsed')}"
DETECTED = f"{LOG},{detector_ctes('parsed', 'd_')},{JUDGED}"
GROUPED = f"{DETECTED},{incident_ctes('judged', 'is_anomaly', 'i_')},{TECHNIQUE_TABLE},{INCIDENTS}"


def over(ctes: str, select: str) -> str:
    return f"with recursive {ctes.lstrip()}\n{select}"


# --- attack scenarios

def start(low: int, high: int, minutes: int) -> str:
    return (f"(cast(day as timestamp) + to_minutes({between(low, high, *KEY, q('hour'))} * 60 "
            f"+ {between(0, minutes, *KEY, q('minute'))}))")


def login(verb: str, user: str, ip: str, port: str) -> str:
    return f"'{verb} password for ' || {user} || ' from ' || {ip} || ' port ' || {port} || ' ssh2'"


def host(network: str, what: str) -> str:
    return f"({network} || {between(2, 250, *KEY, q(what))})"


ALL_TARGETS = f"""
targets as materialized (
  select 42::bigint as seed, scenario, cast(user_id as integer) as instance,
    'u' || lpad(cast(user_id % 50 as varchar), 2, '0') as "user", '10.0.' || (user_id % 50) || '.' as home
  from (select distinct user_id from events), (values ('A'), ('B'), ('C')) s(scenario)),
target as materialized (
  select *, date '2026-07-14' + cast({draw(3, *KEY, q('day'))} as integer) as day from targets)"""

_HOMES = ", ".join(f"{{'u': {q(u)}, 'h': {q(h)}}}" for u, h in t.HOMES)
MATRIX_TARGETS = f"""
plan as (
  select cast(seed as bigint) as seed, scenario, cast(instance as integer) as instance
  from (values {", ".join(f"({s})" for s in t.SEEDS)}) a(seed), (values ('A'), ('B'), ('C')) b(scenario),
       (values (1), (2), (3)) c(instance)),
planned as (select *, ([{_HOMES}])[{draw(len(t.HOMES), *KEY, q('user'))} + 1] as account from plan),
target as materialized (
  select seed, scenario, instance, account.u as "user", account.h as home,
    date '2026-07-14' + cast({draw(3, *KEY, q('day'))} as integer) as day from planned)"""


def _kinds(kinds) -> str:
    return "case kind " + " ".join(f"when {q(k)} then {q(DESCRIPTIONS[k])}" for k in kinds) + " end"


PID = f"cast(1000 + {draw(60000, *KEY, q('pid'), 'step')} as integer)"
ATTACKS = f"""
a0 as (
  select *, cast({between(3, 5, *KEY, q('tries'))} as integer) as n from target where scenario = 'A'),
a1 as (select *, unnest(generate_series(0, n + 2)) as step from a0),
a2 as (
  select *, case when step < n then 'failed' when step = n then 'accepted' when step = n + 1 then 'su' else 'group' end as kind,
    case when step = 0 then 0 when step <= n then {between(1, 4, *KEY, 'step', q('gap'))}
      when step = n + 1 then {between(15, 45, *KEY, 'step', q('gap'))}
      else {between(20, 60, *KEY, 'step', q('gap'))} end as gap from a1),
a3 as (
  select *, {start(1, 5, 59)} + to_seconds(sum(gap) over (partition by seed, scenario, instance order by step)) as ts,
    {host(q(INSIDER_NETWORK), 'ip')} as ip, {between(50000, 65000, *KEY, q('port'))} as port from a2),
atk_a as (
  select seed, ts, case kind when 'su' then 'sudo' when 'group' then 'usermod' else 'sshd' end as process, {PID} as pid,
    case kind when 'failed' then {login('Failed', '"user"', 'ip', 'port')}
      when 'accepted' then {login('Accepted', '"user"', 'ip', 'port')}
      when 'su' then 'user=' || "user" || ' : COMMAND=/bin/su root'
      else 'user=' || "user" || ' added new user ''backdoor' || printf('%02d', instance) || ''' to group sudo' end as message,
    scenario, instance, "user", {_kinds(['failed', 'accepted', 'su', 'group'])} as description, step from a3),
b0 as (select *, unnest([0, 1]) as step from target where scenario = 'B'),
b1 as (select *, case step when 0 then 'home' else 'foreign' end as kind,
    case step when 0 then {host('home', 'home ip')}
      else {host(pick(FOREIGN_NETWORKS, *KEY, q('network')), 'foreign ip')} end as ip from b0),
atk_b as (
  select seed, {start(7, 20, 40)} + to_seconds(step * 900) as ts, 'sshd' as process, {PID} as pid,
    {login('Accepted', '"user"', 'ip', between(50000, 65000, *KEY, q('port'), 'step'))} as message,
    scenario, instance, "user", {_kinds(['home', 'foreign'])} as description, step from b1),
c0 as (select *, unnest({listed(PROBED_NAMES)}) as name, {between(6, 8, *KEY, q('names'))} as names
  from target where scenario = 'C'),
c1 as (select *, row_number() over (partition by seed, scenario, instance
    order by md5(concat_ws('|', seed, scenario, instance, name)), name) - 1 as step from c0 qualify step < names),
c2 as (select *, case when step = 0 then 0 else {between(2, 6, *KEY, 'step', q('gap'))} end as gap from c1),
atk_c as (
  select seed, {start(0, 23, 59)} + to_seconds(sum(gap) over (partition by seed, scenario, instance order by step)) as ts,
    'sshd' as process, {PID} as pid,
    {login('Failed', 'name', host(pick(FOREIGN_NETWORKS, *KEY, q('network')), 'ip'), between(50000, 65000, *KEY, q('port'), 'step'))} as message,
    scenario, instance, name as "user", {q(DESCRIPTIONS['probe'])} as description, step from c2),
attack as materialized (
  select * from atk_a union all select * from atk_b union all select * from atk_c)"""

ROW = 'seed, scenario, instance, cast(step as integer) as step, ts, process, pid, message, "user", description'
ROWKEY = (*KEY, "step")


def camouflage_ctes(strategies, p: str) -> tuple[str, str]:
    """CTEs that disguise ``attack``; returns them and the name of the last one."""
    chosen, last, out = set(strategies), "attack", []
    inst = "partition by seed, scenario, instance"

    def step(name: str, body: str) -> None:
        nonlocal last
        out.append(f"{p}{name} as materialized (" + body.replace("{last}", last) + ")")
        last = p + name

    if "volume" in chosen:
        step("vol", f"""select * from {{last}} qualify
          row_number() over ({inst} order by ts, step) = 1 or row_number() over ({inst} order by ts desc, step desc) = 1
          or {draw(1000000, *ROWKEY, q('keep'))} < 500000""")
    if "rephrase" in chosen:
        cases = " ".join(
            f"when contains(lower(message), {q(w.lower())}) then replace(message, {q(w)}, {pick(o, *ROWKEY, q('rephrase'))})"
            for w, o in REPHRASINGS)
        step("reph", f"select * replace (case {cases} else message end as message) from {{last}}")
    if "mimicry" in chosen:
        step("mim", """select * replace (
          case when contains(message, 'COMMAND=/bin/su root') then 'pam_unix(sudo:session): session opened for user root by (uid=0)'
               when contains(message, 'added new user') then 'pam_unix(sudo:session): session opened for user '
                 || case when contains(message, '''') then split_part(message, '''', 2) else coalesce(nullif("user", ''), 'root') end
                 || ' by (uid=0)' else message end as message) from {last}""")
    if "ip_rotate" in chosen:
        new = f"{pick(FOREIGN_NETWORKS, *ROWKEY, q('network'))} || {between(2, 250, *ROWKEY, q('address'))}"
        step("rot", f"select * replace (regexp_replace(message, '{IP}', {new}) as message) from {{last}}")
    if chosen & {"slow", "temporal"}:
        low, high = (35, 90) if "slow" in chosen else (8, 20)
        gap = between(low, high, *ROWKEY, q("gap"))
        step("gaps", f"""select *, case when row_number() over ({inst} order by ts, step) = 1 then 0 else {gap} end as gap,
          first_value(ts) over ({inst} order by ts, step) as ts0 from {{last}}""")
        step("spread", f"""select * exclude (gap, ts0)
          replace (ts0 + to_minutes(cast(sum(gap) over ({inst} order by ts, step) as bigint)) as ts) from {{last}}""")
    if "noise" in chosen:
        nk = (*ROWKEY, q("noise"))
        which = draw(len(FILLER), *nk, q("line"))
        text = " ".join(f"when {i} then replace(replace({q(line)}, '{{n}}', n), '{{user}}', usr)"
                        for i, (_, line) in enumerate(FILLER))
        process = " ".join(f"when {i} then {q(proc)}" for i, (proc, _) in enumerate(FILLER))
        step("span", """select seed, scenario, instance, min(ts) as t0,
          greatest(cast(date_diff('second', min(ts), max(ts)) as bigint), 60) as secs, count(*) * 3 // 2 as amount
          from {last} group by all""")
        names = [o.split(" as ")[0] for o in out]
        before = names[-2] if len(names) > 1 else "attack"
        step("nrow", "select *, unnest(generate_series(1, amount)) as step from {last}")
        step("ndraw", f"""select *, {which} as which, cast({between(1, 254, *nk, q('n'))} as varchar) as n,
          {pick(t.USERS, *nk, q('user'))} as usr, {draw('secs + 1', *nk, q('at'))} as late,
          {draw(60000, *nk, q('pid'))} as pn from {{last}}""")
        step("noisy", f"""select seed, ts, process, pid, message, scenario, instance, "user", description, step from {before}
          union all
          select seed, t0 + to_seconds(late), case which {process} end,
            cast(case which {" ".join(f"when {i} then 1" for i, (pr, _) in enumerate(FILLER) if pr == 'systemd')} else 1000 + pn end as integer),
            case which {text} end, null, null, null, null, step from {{last}}""")
    return ",\n".join(out), last


def corpora_ctes() -> str:
    ctes, unions = [], []
    for at, (name, strategies) in enumerate(ROBUSTNESS_CONDITIONS.items()):
        body, last = camouflage_ctes(strategies, f"k{at}_")
        if body:
            ctes.append(body)
        unions.append(f'select seed, {q(name)} as condition, ts, process, pid, message, scenario, instance, "user", '
                      f"description, step from {last}")
    seeds = ", ".join(f"({s})" for s in t.SEEDS)
    names = ", ".join(f"({q(n)})" for n in ROBUSTNESS_CONDITIONS)
    ctes.append(f"""every as (
      {" union all ".join(unions)}
      union all
      select cast(s.seed as bigint), c.condition, ts, process, pid, message, null, null, null, null, event_id
      from m, (values {seeds}) s(seed), (values {names}) c(condition))""")
    ctes.append("""corpus as materialized (select *, row_number() over (partition by seed, condition
      order by ts, coalesce(scenario, ''), coalesce(instance, 0), step, message, pid) as line_number from every)""")
    ctes.append(rf"""cparsed as materialized (select seed, condition, line_number, ts as "timestamp", message,
      coalesce(nullif(regexp_extract(message, '(?i)\buser[= ]([\w\-]+)\b', 1), ''),
               nullif(regexp_extract(message, 'for ([\w\-]+) from', 1), ''), 'unknown') as "user",
      nullif(regexp_extract(message, '{IP}', 0), '') as source_ip from corpus)""")
    return ",\n".join(ctes)


RUN = ("seed", "condition")
CORPORA = f"{RENDERED},{MATRIX_TARGETS},{ATTACKS},\n{corpora_ctes()}"
MEASURED = f"""{CORPORA},{detector_ctes('cparsed', 'e_', RUN)},
pred as materialized (select seed, condition, line_number, rules_fired, impossible_travel, rules_fired <> '' as rules,
  rules_fired <> '' or impossible_travel as rules_travel, impossible_travel as travel_rule,
  "timestamp", "user", source_ip from e_found),
label as materialized (select seed, condition, line_number, scenario, instance, ts as "timestamp", "user"
  from corpus where scenario is not null),
hit as materialized (select l.seed, l.condition, l.scenario, l.instance, l.line_number, p.rules, p.rules_travel, p.travel_rule
  from label l join pred p on l.seed = p.seed and l.condition = p.condition and l.line_number = p.line_number),
long as (select * from hit unpivot (flag for detector in (rules, rules_travel, travel_rule))),
inst as (select seed, condition, detector, scenario, instance, count(*) as lines, count(*) filter (where flag) as tp from long group by all),
sc as materialized (select seed, condition, detector, scenario, cast(sum(tp) as bigint) as tp, cast(sum(lines) as bigint) as attack_lines,
  count(*) as instances, count(*) filter (where tp > 0) as instances_detected from inst group by all),
fl as (select seed, condition, count(*) filter (where rules) as rules, count(*) filter (where rules_travel) as rules_travel,
  count(*) filter (where travel_rule) as travel_rule from pred group by all),
flong as (select * from fl unpivot (flagged for detector in (rules, rules_travel, travel_rule))),
conf as materialized (select seed, condition, detector, cast(sum(tp) as bigint) as tp,
  cast(any_value(flagged) - sum(tp) as bigint) as fp, cast(sum(attack_lines) - sum(tp) as bigint) as fn,
  any_value(flagged) as flagged, cast(sum(attack_lines) as bigint) as attack_lines,
  cast(sum(instances) as bigint) as instances, cast(sum(instances_detected) as bigint) as instances_detected
  from sc join flong using (seed, condition, detector) group by all)"""


def r3(expression: str) -> str:
    return f"round_even({expression}, 3)"


def div(a: str, b: str) -> str:
    return f"coalesce({a} / nullif(cast({b} as double), 0), 0.0)"


P, R = div("tp", "(tp + fp)"), div("tp", "(tp + fn)")
RATES = (f"{r3(P)} as precision, {r3(R)} as recall, {r3(div(f'(2 * {P} * {R})', f'({P} + {R})'))} as f1, "
         f"{r3(div('instances_detected', 'instances'))} as instance_detection_rate")
POOLED = f"""{MEASURED},
summed as (select condition, detector, {", ".join(f"cast(sum({c}) as bigint) as {c}" for c in
  ("tp", "fp", "fn", "flagged", "attack_lines", "instances", "instances_detected"))} from conf group by all),
pooled as (select *, {RATES} from summed)"""
ROBUST_RATES = (f"{r3(div('lines_detected', 'attack_lines'))} as line_detection_rate, "
                f"{r3(div('instances_detected', 'instances'))} as instance_detection_rate")
ROBUST = f"""{MEASURED},
ri as (select seed, condition, scenario, instance, count(*) as lines, count(*) filter (where rules_travel) as det, count(*) filter (where travel_rule) as trav
  from hit group by all),
rob as materialized (select seed, condition, scenario, cast(sum(lines) as bigint) as attack_lines, cast(sum(det) as bigint) as lines_detected,
  count(*) as instances, count(*) filter (where det > 0) as instances_detected, cast(sum(trav) as bigint) as impossible_travel_hits
  from ri group by all)"""
_SUMS = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in
                  ("attack_lines", "lines_detected", "instances", "instances_detected"))
ROBUST_POOLED = f"""{ROBUST},
rp0 as (select condition, scenario, {_SUMS}, cast(sum(impossible_travel_hits) as bigint) as impossible_travel_hits from rob group by all),
rp as materialized (select *, {ROBUST_RATES} from rp0)"""
ROBUST_OVERALL = f"""{ROBUST},{incident_ctes('pred', 'rules_travel', 'g_', RUN)},
ginc as (select seed, condition, max(incident_id) + 1 as incidents from g_id group by all),
gfl as (select seed, condition, count(*) filter (where rules_travel) as total_flagged_lines from pred group by all),
ro0 as (select seed, condition, {_SUMS} from rob group by all),
ro1 as (select ro0.*, coalesce(total_flagged_lines, 0) as total_flagged_lines, coalesce(incidents, 0) as incidents
  from ro0 left join gfl using (seed, condition) left join ginc using (seed, condition)),
ro as materialized (select *, {ROBUST_RATES} from ro1)"""
EVERY_RUN = f"""{MEASURED},{incident_ctes('pred', 'rules_travel', 'n_', RUN)},
ctag as materialized (select c.*, i.incident_id from pred c join n_id i using (seed, condition, line_number)),
skey as (select distinct seed, condition, incident_id, "timestamp", "user" from ctag),
votes as (select k.seed, k.condition, k.incident_id, l.scenario, count(*) as n
  from label l join skey k using (seed, condition, "timestamp", "user") group by all),
scen as materialized (select seed, condition, incident_id, scenario from votes
  qualify row_number() over (partition by seed, condition, incident_id order by n desc, scenario) = 1),
cinc as (select seed, condition, incident_id, count(*) as event_count,
  case when bool_or(impossible_travel) then 'high' else 'low' end as severity from ctag group by all),
sample as materialized (select seed, condition, scenario, incident_id, event_count, severity
  from cinc join scen using (seed, condition, incident_id)
  where severity = 'high' or event_count >= 2
  qualify row_number() over (partition by seed, condition, scenario order by event_count desc, incident_id) = 1)"""


def _prompt() -> str:
    slots = {"summary": "summary_block", "events": "events_block", "techniques": "technique_block", "sentences": "'4-6'"}
    left, out = PROMPT, []
    for name, value in slots.items():
        before, left = left.split("{" + name + "}")
        out += [q(before), value]
    return " || ".join([*out, q(left)])


FIELD = "case when lower(trim({0})) in ('', 'nan', 'none', 'unknown') then null else trim({0}) end"
PROMPTS = f"""{GROUPED},
ranked as (select *, row_number() over (partition by incident_id order by "timestamp", line_number) as nth from tagged),
evb as (select incident_id, string_agg('- [' || cast("timestamp" as varchar) || ']'
    || coalesce(' user=' || {FIELD.format('"user"')}, '') || coalesce(' src=' || {FIELD.format('source_ip')}, '')
    || ' : ' || message, chr(10) order by nth) as block from ranked where nth <= 25 group by all),
blocks as (
  select i.incident_id,
    '- ' || event_count || ' anomalous events from ' || cast("start" as varchar) || ' to ' || cast("end" as varchar) || chr(10)
    || '- Distinct usernames involved (' || len(u) || '): ' || case when len(u) = 0 then 'n/a' else array_to_string(u, ', ') end || chr(10)
    || '- Distinct source IPs (' || len(source_ips) || '): '
    || case when len(source_ips) = 0 then 'n/a' else array_to_string(source_ips, ', ') end
    || case when travelled then chr(10) || {q(TRAVEL_NOTE)} else '' end as summary_block,
    block || case when event_count > 25 then chr(10) || '- ... and ' || (event_count - 25) || ' further similar events' else '' end as events_block,
    technique_block
  from (select *, list_filter(users, lambda x: lower(trim(x)) not in ('', 'nan', 'none', 'unknown')) as u from inc) i
  join evb using (incident_id))"""


_RULES = ", ".join(f"({q(name)})" for name in RULES)


def statements() -> dict[str, str]:
    s: dict[str, str] = {}
    s["flagship"] = over(DETECTED, f"""select "user", count(*) as events, count(*) filter (where impossible_travel) as travel,
      count(*) filter (where is_anomaly) as anomalies, ['none','low','medium','high'][max({RANK})] as worst from judged group by all""")
    s["format_lines"] = s["text_roundtrip"] = over(RENDERED, "select line_number, value from lines")
    s["parse_lines"] = s["parsed_roundtrip"] = over(LOG, """select line_number, "timestamp", host, process, pid, message, raw,
      "user", source_ip, template from parsed""")
    s["rejected_lines"] = r"""with raw as (select lang, unnest(string_split(text, chr(10))) as value from documents)
      select lang, count(*) as lines, count(*) filter (where not regexp_matches(trim(value, chr(9) || chr(13) || ' '),
        '^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+[\w\-/.]+(\[\d+\])?:\s+')) as rejected
      from raw group by all"""
    s["message_templates"] = over(LOG, """select template, count(*) as events, count(distinct "user") as users
      from parsed group by all""")
    s["successful_logins"] = over(LOG, """select split_part(source_ip, '.', 1) || '.' || split_part(source_ip, '.', 2) as subnet,
      count(*) as logins, count(distinct "user") as users from parsed
      where contains(lower(message), 'accepted password') and source_ip is not null group by all""")
    s["identities"] = over(LOG, f"""select {identity('"user"')} as identity, {FIELD.format('"user"')} as field,
      count(*) as events, count({identity('source_ip')}) as with_address from parsed group by all""")
    s["impossible_travel"] = over(DETECTED, """select line_number, "timestamp", "user", source_ip from d_found where impossible_travel""")
    for rule, cte in (("brute_force", "brute"), ("enumeration", "enum"), ("privileged_command", "priv")):
        s[f"rule_{rule}"] = over(DETECTED, f"select line_number from d_{cte}")
    s["streaming_rules"] = over(DETECTED, " union all ".join(
        [f"select '{rule}' as rule, line_number from d_{cte}"
         for rule, cte in (("brute_force", "brute"), ("enumeration", "enum"), ("privileged_command", "priv"))]
        + ["select 'impossible_travel', line_number from d_found where impossible_travel"]))
    s["rules_fired"] = over(DETECTED, "select line_number, rules_fired, rules_fired <> '' as is_anomaly from d_found")
    s["rule_counts"] = over(DETECTED, f"""select r.rule, count(c.rule) as lines_claimed
      from (values {_RULES}) r(rule) left join d_claims c on r.rule = c.rule group by all""")
    s["severity_tiers"] = over(DETECTED, "select line_number, is_anomaly, impossible_travel, severity from judged")
    shares = ", ".join(f"({c})" for c in CONTAMINATION_SWEEP)
    s["quantile_threshold"] = " union all ".join(
        f"select user_id, cast({c} as double) as share, round_even(quantile_cont(value, {c}), 6) as quantile from events group by user_id"
        for c in CONTAMINATION_SWEEP)
    s["outlier_flags"] = """with cut as (select user_id, quantile_cont(value, 0.2) as q from events group by user_id)
      select user_id, count(*) as events, count(*) filter (where value < q) as outliers from events join cut using (user_id) group by all"""
    s["incident_assignment"] = over(GROUPED, "select line_number, incident_id from i_id")
    s["incident_insertion"] = s["incident_assignment"]
    s["incident_assignment_by_user"] = over(
        f"{DETECTED},{incident_ctes('judged', 'is_anomaly', 'i_', by_ip=False)}", "select line_number, incident_id from i_id")
    s["incidents"] = over(GROUPED, """select incident_id, summary, array_to_string(users, ',') as users,
      array_to_string(source_ips, ',') as source_ips, "start", "end", event_count, severity, techniques, notable from inc""")
    s["incident_users"] = over(GROUPED, 'select distinct incident_id, "user" from tagged')
    s["incident_events"] = over(GROUPED, """select incident_id, line_number, coalesce(cast("timestamp" as varchar), '') as "timestamp",
      coalesce("user", '') as "user", coalesce(source_ip, '') as source_ip, coalesce(message, '') as message from tagged""")
    s["incident_records"] = over(GROUPED, """select incident_id, summary, array_to_string(users, ',') as users,
      cast("start" as varchar) as "start", cast("end" as varchar) as "end", event_count, severity, technique_names as techniques from inc""")
    s["incident_event_records"] = over(GROUPED, """select incident_id,
      row_number() over (partition by incident_id order by "timestamp", line_number) - 1 as position,
      coalesce(cast("timestamp" as varchar), '') as "timestamp", coalesce("user", '') as "user",
      coalesce(source_ip, '') as source_ip, coalesce(message, '') as message from tagged""")
    s["run_counters"] = over(GROUPED, """select count(*) as log_rows, count(*) filter (where is_anomaly) as flagged,
      count(*) filter (where impossible_travel) as via_travel, (select count(*) from inc) as incidents,
      (select count(*) filter (where event_count > 1) from inc) as multi_event from judged""")
    s["message_techniques"] = over(f"{LOG},{TECHNIQUE_TABLE}", """select line_number, technique_id, technique_name, tactic
      from parsed g join tech k on len(list_filter(k.words, lambda w: contains(lower(g.message), w))) > 0""")
    s["incident_signals"] = over(GROUPED, "select incident_id, signal from sig")
    s["incident_techniques"] = over(GROUPED, """select incident_id, position, technique_id, technique_name, tactic, evidence from itech""")
    s["incident_prompts"] = over(PROMPTS, f"""select incident_id, summary_block, events_block, technique_block,
      {_prompt()} as prompt from blocks""")
    s["triage_board"] = over(GROUPED, f"""select incident_id, event_count, severity,
      row_number() over (order by event_count desc, {RANK} desc, incident_id) as place from inc""")
    s["triage_top"] = over(GROUPED, f"""select incident_id, event_count, severity from inc
      order by event_count desc, {RANK} desc, incident_id limit 20""")
    s["triage_headline"] = over(GROUPED, """select count(*) as incidents, count(*) filter (where severity = 'high') as high_severity,
      count(*) filter (where notable) as notable, count(*) filter (where not notable) as hidden from inc""")
    s["triage_selection"] = over(GROUPED, """select incident_id, severity, event_count from inc where notable
      and severity in ('high', 'medium') and list_contains(users, 'u01') and techniques <> ''""")
    s["user_facet"] = over(GROUPED, 'select distinct "user" from tagged')

    near = ", ".join(f"""case when abs(epoch_us(ok."timestamp") - epoch_us({a}."timestamp")) <= 3600000000
      then {a}.line_number end as {n}_line_number""" for a, n in (("prior", "backward"), ("later", "forward")))
    s["login_neighbours"] = over(f"""{LOG},
      ok as (select line_number, "user", "timestamp" from parsed where contains(lower(message), 'accepted password')),
      tries as (select "user", "timestamp", min(line_number) as low, max(line_number) as high from parsed
        where contains(lower(message), 'failed password') group by all),
      prior as (select ok.line_number as at, x."timestamp", x.high as line_number
        from ok asof join tries x on ok."user" = x."user" and ok."timestamp" >= x."timestamp"),
      later as (select ok.line_number as at, x."timestamp", x.low as line_number
        from ok asof join tries x on ok."user" = x."user" and ok."timestamp" <= x."timestamp"),
      both_ways as (select ok.line_number, ok."user", {near}, epoch_us(ok."timestamp") - epoch_us(prior."timestamp") as back,
        epoch_us(later."timestamp") - epoch_us(ok."timestamp") as ahead
        from ok left join prior on prior.at = ok.line_number left join later on later.at = ok.line_number)""",
      """select line_number, "user", backward_line_number, forward_line_number, case when backward_line_number is not null
        and (forward_line_number is null or back <= ahead) then backward_line_number else forward_line_number end as nearest_line_number
        from both_ways""")
    s["incident_logins"] = over(GROUPED, """select incident_id, count(*) as logins, count(distinct p."user") as users from inc
      join parsed p on p."timestamp" between inc."start" and inc."end" where contains(lower(message), 'accepted password') group by all""")
    s["incident_overlaps"] = over(GROUPED, """select a.incident_id, count(*) - 1 as others from inc a
      join inc b on a."start" <= b."end" and b."start" <= a."end" group by all""")
    s["user_sessions"] = over(f"""{LOG},
      g as (select "user", "timestamp", "timestamp" + case when contains(lower(message), 'failed password')
        then interval 5 minute else interval 10 minute end as until from parsed where "timestamp" is not null),
      o as (select *, coalesce("timestamp" > max(until) over (partition by "user" order by "timestamp"
        range between unbounded preceding and interval 1 microsecond preceding), true) as opens from g),
      n as (select *, max(case when opens then "timestamp" end) over (partition by "user" order by "timestamp") as session_start from o)""",
      """select "user", session_start, max(until) as session_end, count(*) as events from n group by all""")
    s["value_ranks"] = """select event_id, v as value, rank() over o as rank, dense_rank() over o as dense_rank,
      percent_rank() over o as percent_rank, cume_dist() over o as cume_dist,
      cast(ntile(7) over (order by v nulls first, event_id) as integer) as tile
      from (select event_id, round(value, 0) as v from events) window o as (order by v nulls first)"""
    s["sketched_values"] = """select event_type, count(*) as rows, count(distinct value) as values, true as values_hold, true as median_holds
      from events group by all"""

    s["scenario_targets"] = over(ALL_TARGETS, 'select seed, scenario, instance, "user", home, day from target')
    made = f"{ALL_TARGETS},{ATTACKS}"
    for name, cte in (("inject_brute_force", "atk_a"), ("inject_travel", "atk_b"), ("inject_enumeration", "atk_c")):
        s[name] = over(made, f"select {ROW} from {cte}")
    for name, chosen in [*((n, [n]) for n in STRATEGIES), ("combo", REALISTIC_COMBO)]:
        body, last = camouflage_ctes(chosen, "k_")
        s[f"camouflage_{name}"] = over(f"{made},\n{body}", f"select {ROW} from {last}")
    merged = f"""{RENDERED},{made},
      every as (select ts, process, pid, message, null::varchar as scenario, null::integer as instance, null::varchar as "user", null::varchar as description, event_id as step from m
        union all select ts, process, pid, message, scenario, instance, "user", description, step from attack),
      corpus as (select *, row_number() over (order by ts, coalesce(scenario, ''), coalesce(instance, 0), step, message, pid) as line_number
        from every)"""
    s["corpus_lines"] = over(merged, """select line_number, strftime(ts, '%b %d %H:%M:%S') || ' server1 ' || process || '[' || pid || ']: '
      || message as value, scenario, cast(instance as integer) as instance from corpus""")
    s["corpus_labels"] = over(merged, """select line_number, ts as "timestamp", "user", scenario, cast(instance as integer) as instance,
      description from corpus where scenario is not null""")

    s["scenario_counts"] = over(MEASURED, "select * from sc")
    s["confusion_counts"] = over(MEASURED, "select * from conf")
    s["run_rates"] = over(MEASURED, f"select *, {RATES} from conf")
    s["pooled_rates"] = over(POOLED, "select * from pooled")
    s["pooled_scenarios"] = over(MEASURED, f"""select condition, detector, scenario, tp, attack_lines, instances, instances_detected,
      {r3(div('tp', 'attack_lines'))} as line_detection_rate, {r3(div('instances_detected', 'instances'))} as instance_detection_rate
      from (select condition, detector, scenario, {", ".join(f"cast(sum({c}) as bigint) as {c}" for c in
        ("tp", "attack_lines", "instances", "instances_detected"))} from sc group by all)""")
    s["scenario_levels"] = over(MEASURED, """select condition, detector, scenario, grouping_id(condition, detector, scenario) as level,
      cast(sum(tp) as bigint) as tp, cast(sum(attack_lines) as bigint) as attack_lines, cast(sum(instances) as bigint) as instances,
      cast(sum(instances_detected) as bigint) as instances_detected from sc group by cube (condition, detector, scenario)""")
    s["corpora_rule_counts"] = over(MEASURED, f"""select k.condition, r.rule, count(c.rule) as lines_claimed
      from (select distinct condition from pred) k cross join (values {_RULES}) r(rule)
      left join e_claims c on r.rule = c.rule and k.condition = c.condition group by all""")
    s["robustness_runs"] = over(ROBUST, f"select *, {ROBUST_RATES} from rob")
    s["robustness_overall"] = over(ROBUST_OVERALL, "select * from ro")
    s["robustness_pooled"] = over(ROBUST_OVERALL, f"""select *, {ROBUST_RATES} from (select condition, count(*) as seeds, {_SUMS},
      cast(sum(total_flagged_lines) as bigint) as total_flagged_lines, cast(sum(incidents) as bigint) as incidents,
      string_agg(cast(instance_detection_rate as varchar), ',' order by seed) as per_seed_instance_rate from ro group by all)""")
    order = list(ROBUSTNESS_CONDITIONS)
    s["strategy_ranking"] = over(ROBUST, f"""select condition, instance_detection_rate, instance_delta, line_detection_rate, line_delta,
      row_number() over (order by instance_delta, line_delta, list_position({listed(order)}, condition)) as rank
      from (select p.condition, p.instance_detection_rate, {r3("p.instance_detection_rate - b.instance_detection_rate")} as instance_delta,
        p.line_detection_rate, {r3("p.line_detection_rate - b.line_detection_rate")} as line_delta
        from (select *, {ROBUST_RATES} from (select condition, {_SUMS} from rob group by all)) p,
             (select *, {ROBUST_RATES} from (select condition, {_SUMS} from rob group by all)) b
        where b.condition = 'baseline' and p.condition <> 'baseline')""")
    s["lossy_scenarios"] = over(ROBUST_POOLED, """select p.scenario, p.condition, p.instance_detection_rate,
      b.instance_detection_rate as clean_rate from rp p join rp b on p.scenario = b.scenario and b.condition = 'baseline'
      where p.instance_detection_rate < b.instance_detection_rate""")
    # only asked where every loss lies in one scenario
    s["compensating_conditions"] = over(ROBUST_POOLED, """select scenario, condition, instances_detected, impossible_travel_hits
      from rp where instances_detected > impossible_travel_hits and scenario in (
        select p.scenario from rp p join rp b on p.scenario = b.scenario and b.condition = 'baseline'
        where p.instance_detection_rate < b.instance_detection_rate)
      and (select count(distinct p.scenario) from rp p join rp b on p.scenario = b.scenario and b.condition = 'baseline'
        where p.instance_detection_rate < b.instance_detection_rate) = 1""")
    for name, value in (("", "line_detection_rate"), ("_instances", "instance_detection_rate"), ("_travel", "impossible_travel_hits")):
        s[f"scenario_matrix{name}"] = over(ROBUST_POOLED, "select condition, " + ", ".join(
            f"max({value}) filter (where scenario = '{c}') as {c}" for c in "ABC") + " from rp group by all")
    s["side_by_side"] = over(POOLED, f"""select a.condition, a.recall as rules_recall, b.recall as rules_travel_recall,
      {r3("b.recall - a.recall")} as recall_delta, a.f1 as rules_f1, b.f1 as rules_travel_f1, {r3("b.f1 - a.f1")} as f1_delta
      from pooled a join pooled b on a.condition = b.condition and a.detector = 'rules' and b.detector = 'rules_travel'""")
    s["incident_scenarios"] = over(EVERY_RUN, "select seed, condition, incident_id, scenario from scen")
    s["scenario_samples"] = over(EVERY_RUN, "select seed, condition, scenario, incident_id, event_count, severity from sample")
    names = ", ".join(f"({q(c)}, {q(title)})" for c, title in SCENARIOS)
    s["uncovered_scenarios"] = over(EVERY_RUN, f"""select r.seed, r.condition, n.scenario, n.title
      from (select distinct seed, condition from label) r, (values {names}) n(scenario, title)
      where not exists (select 1 from sample x where x.seed = r.seed and x.condition = r.condition and x.scenario = n.scenario)""")
    return s
