"""Times, URLs, conversions, commands and hashes as column expressions."""

from tallyrow.plans.query import Query

# What makes a command dangerous.
DANGEROUS = [
    "rm -rf /",
    "rm -rf ~",
    "rm -rf $HOME",
    "rm -rf /*",
    "sudo ",
    "mkfs",
    "dd if=",
    ":(){ :|:&};:",
    "> /dev/sda",
    "chmod -R 777 /",
    "chown -R",
    "kill -9 1",
    "shutdown",
    "reboot",
    "halt",
    "init 0",
    "init 6",
    "format c:",
    "del /f /s /q",
    "rf -rf",
]
# What shows that a prompt has three options.
THREE_OPTIONS = ["don''t ask again", "don’t ask again", "don.taskagain", "don''taskagain"]


def dangerous(command: str) -> str:
    """SQL: whether a command holds one of DANGEROUS, in any case."""
    return "(" + " OR ".join(f"contains(lower({command}), '{x.lower()}')" for x in DANGEROUS) + ")"


def response_key(decision: str, prompt: str) -> str:
    """SQL: the key that answers a prompt of two or three options."""
    three = " OR ".join(f"contains({prompt}, '{x}')" for x in THREE_OPTIONS)
    return f"CASE WHEN {three} THEN CASE {decision} WHEN 'allow-always' THEN '2' WHEN 'allow-once' THEN '1' ELSE '3' END ELSE CASE {decision} WHEN 'deny' THEN '2' ELSE '1' END END"


def command_parts(text: str) -> str:
    """SQL: kind and argument of a colon command; kind is null if it isn't one."""
    word = lambda n: f"regexp_extract({text}, RX'^\\s*:\\s*{'\\S+\\s+' * n}(\\S+)', 1)"
    head, second, third = word(0), word(1), word(2)
    return f"""CASE WHEN {head} = 'spawn' AND {second} IN ('cc', 'claude', 'claude-code') THEN 'spawn-a' WHEN {head} = 'spawn' AND {second} = 'codex' THEN 'spawn-b'
      WHEN {head} = 'agents' THEN 'agents' WHEN {head} = 'kill' AND MATCHES({second}, RX'^\\+?[0-9]+$') THEN 'kill' WHEN {head} = 'models' THEN 'models'
      WHEN {head} = 'voice' AND lower({second}) IN ('on', 'true', '1', 'yes') THEN 'voice-on' WHEN {head} = 'voice' AND lower({second}) IN ('off', 'false', '0', 'no') THEN 'voice-off'
      WHEN {head} = 'tts' AND {second} = 'voice' AND {third} <> '' THEN 'tts-voice' END AS kind,
      CASE WHEN {head} IN ('spawn', 'tts') THEN {third} WHEN {head} IN ('kill', 'voice') THEN {second} ELSE '' END AS argument"""


_COMMANDS = "(SELECT event_id, CASE event_id % 9 WHEN 0 THEN ':spawn cc /tmp' WHEN 1 THEN '  :kill 17' WHEN 2 THEN ':voice OFF' WHEN 3 THEN ':tts voice amy' WHEN 4 THEN ':spawn vim' WHEN 5 THEN 'ls' WHEN 6 THEN ':agents' WHEN 7 THEN ':kill x' ELSE ':' END AS line FROM events)"
_SHELL = "(SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'SUDO ls' WHEN 1 THEN 'rm -rf $home' WHEN 2 THEN 'ls -l' WHEN 3 THEN 'init 6' WHEN 4 THEN 'git status' WHEN 5 THEN ':(){ :|:&};:' ELSE event_type END AS command FROM events)"
_PROMPTS = "(SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'allow-always' WHEN 1 THEN 'allow-once' ELSE 'deny' END AS decision, CASE WHEN event_id % 2 = 0 THEN 'yes, and don''t ask again' ELSE 'yes or no' END AS prompt FROM events)"
_ISO = "(SELECT event_id, concat('2024-01-', CASE WHEN event_id % 28 < 9 THEN '0' ELSE '' END, CAST(event_id % 28 + 1 AS STRING), 'T0', CAST(event_id % 10 AS STRING), ':30:15', CASE WHEN event_id % 3 = 0 THEN 'Z' WHEN event_id % 3 = 1 THEN '+02:00' ELSE '-05:30' END) AS s FROM events)"
_WHEN = "CAST(s AS TIMESTAMP)"
_LINKS = "(SELECT page_id, concat(url, '?q=a%20b+c&n=', CAST(page_id AS STRING), '#part') AS url FROM pages)"
_PART = lambda pattern, group=1: f"regexp_extract(url, RX'{pattern}', {group})"

# The sun over a place: day of the year, declination and equation of time by the usual short series, in degrees and minutes.
_SUN = """(SELECT user_id, lat, lon, d, 0.006918e0 - 0.399912e0 * cos(g) + 0.070257e0 * sin(g) - 0.006758e0 * cos(2 * g) + 0.000907e0 * sin(2 * g) - 0.002697e0 * cos(3 * g) + 0.00148e0 * sin(3 * g) AS decl,
    229.18e0 * (0.000075e0 + 0.001868e0 * cos(g) - 0.032077e0 * sin(g) - 0.014615e0 * cos(2 * g) - 0.040849e0 * sin(2 * g)) AS eqtime
  FROM (SELECT user_id, lat, lon, d, 2 * pi() / 365 * (d - 1 + (12 - 12) / 24e0) AS g FROM (SELECT DISTINCT user_id, CAST(user_id % 140 - 70 AS DOUBLE) AS lat, CAST(user_id % 300 - 150 AS DOUBLE) AS lon, CAST(user_id % 365 + 1 AS INT) AS d FROM events) AS p) AS q)"""
_ANGLE = "(cos(radians(90.833e0)) / (cos(radians(lat)) * cos(decl)) - tan(radians(lat)) * tan(decl))"

QUERIES = {
    # P24
    "colon_command": Query(f"SELECT event_id, {command_parts('line')} FROM {_COMMANDS} AS c"),
    # P20
    "dangerous_command": Query(f"SELECT event_id, {dangerous('command')} AS dangerous FROM {_SHELL} AS c"),
    # P19
    "response_key": Query(f"SELECT event_id, {response_key('decision', 'prompt')} AS response FROM {_PROMPTS} AS p"),
    # A time with its offset; D03: the same with a given format; D04: formatted.
    "parse_rfc3339": Query(f"SELECT event_id, unix_micros({_WHEN}) AS micros FROM {_ISO} AS t", f"SELECT event_id, epoch_us(CAST(s AS TIMESTAMPTZ)) AS micros FROM {_ISO} AS t"),
    "parse_time": Query(f"SELECT event_id, unix_micros(to_timestamp(s, concat('yyyy-MM-dd', chr(39), 'T', chr(39), 'HH:mm:ssXXX'))) AS micros FROM {_ISO} AS t", f"SELECT event_id, epoch_us(CAST(s AS TIMESTAMPTZ)) AS micros FROM {_ISO} AS t"),
    "format_time": Query("SELECT event_id, date_format(ts, 'yyyy/MM/dd HH:mm') AS formatted FROM events", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M') AS formatted FROM events"),
    # Now, and now formatted; compared with a time long past, so that the result is fixed.
    "clock": Query("SELECT n_nationkey, current_timestamp() > TIMESTAMP '2024-01-01 00:00:00' AS later, length(date_format(current_timestamp(), 'yyyy-MM-dd')) AS n FROM nation", "SELECT n_nationkey, now() > TIMESTAMP '2024-01-01 00:00:00' AS later, length(strftime(now()::TIMESTAMP, '%Y-%m-%d')) AS n FROM nation"),
    # Sunrise and sunset in minutes of UTC, null where the sun stays up or down, and at noon whether it is up.
    "sun_times": Query(
        f"SELECT user_id, up, CASE WHEN a IS NOT NULL THEN round(720 - 4 * (lon + a) - eqtime, 6) END AS rise, CASE WHEN a IS NOT NULL THEN round(720 - 4 * (lon - a) - eqtime, 6) END AS sets FROM (SELECT user_id, lon, eqtime, CASE WHEN {_ANGLE} < -1 THEN TRUE WHEN {_ANGLE} > 1 THEN FALSE ELSE 720 BETWEEN 720 - 4 * (lon + degrees(acos({_ANGLE}))) - eqtime AND 720 - 4 * (lon - degrees(acos({_ANGLE}))) - eqtime END AS up, CASE WHEN {_ANGLE} BETWEEN -1 AND 1 THEN degrees(acos({_ANGLE})) END AS a FROM {_SUN} AS s) AS x"
    ),
    # V01, V02
    "url_parts": Query(f"SELECT page_id, {_PART('^([A-Za-z][A-Za-z0-9+.-]*):')} AS scheme, {_PART('^[^:]+://(?:[^/@]*@)?([^/:?#]+)')} AS host, {_PART('^[^:]+://[^/?#]*?:([0-9]+)')} AS port, {_PART('^[^:]+://[^/?#]*([^?#]*)')} AS path, {_PART('[?]([^#]*)')} AS query, {_PART('#(.*)$')} AS fragment FROM {_LINKS} AS u"),
    "file_path": Query(f"SELECT page_id, url_decode(replace({_PART('[?]([^#]*)')}, '+', '%2B')) AS decoded FROM {_LINKS} AS u"),
    # A value as JSON with its nulls.
    "value_to_json": Query("SELECT event_id, to_json(named_struct('k', event_type, 'v', CASE WHEN event_id % 2 = 0 THEN event_id END), map('ignoreNullFields', 'false')) AS json FROM events", "SELECT event_id, CAST(json_object('k', event_type, 'v', CASE WHEN event_id % 2 = 0 THEN event_id END) AS VARCHAR) AS json FROM events"),
    # Only whole numbers that aren't negative. V10: seconds as a duration, in microseconds. V11: an empty object is an empty list.
    "coerce_unsigned": Query("SELECT event_id, CASE WHEN x >= 0 AND x = floor(x) THEN CAST(x AS BIGINT) END AS whole FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1.0e0 WHEN event_id % 3 = 1 THEN event_id * 1.0e0 ELSE event_id + 0.5e0 END AS x FROM events) AS e"),
    "duration": Query("SELECT event_id, CAST(round(value * 1000000) AS BIGINT) AS micros FROM events"),
    "empty_list": Query("SELECT event_id, CASE WHEN j = '{}' THEN '[]' ELSE j END AS list FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{}' ELSE '[1]' END AS j FROM events) AS e"),
    # A record with one known field; whether it has others.
    "record_fields": Query("SELECT event_id, get_json_object(props, '$.k') AS k, size(json_object_keys(props)) > 1 AS unknown_fields FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) > 1 AS unknown_fields FROM events"),
    # A hash of 128 bits of each row.
    "shape_hash": Query("SELECT doc_id, row, md5(line) AS h FROM {lines} AS l WHERE row < 3"),
    # text of 16-bit units; F17: a row's text from its cells; F18: tokens of an option expanded.
    "utf16_to_utf8": Query("SELECT p_partkey, decode(encode(p_name, 'UTF-16LE'), 'UTF-16LE') AS text FROM part", "SELECT p_partkey, p_name AS text FROM part"),
    "recompose": Query("SELECT p_brand, TEXTAGG(p_name; ''; p_partkey) AS text FROM part GROUP BY p_brand"),
    "expand_tokens": Query("SELECT c_custkey, replace(replace(replace('%r@%h:%p', '%r', c_mktsegment), '%h', c_name), '%p', CAST(c_nationkey AS STRING)) AS value FROM customer"),
    # A list's lines, split and typed.
    "pane_items": Query("SELECT CAST(substring(split(line, ' ')[0], 2) AS BIGINT) AS session, CAST(substring(split(line, ' ')[1], 2) AS BIGINT) AS pane, split(line, ' ')[2] AS title FROM (SELECT concat('$', CAST(c_nationkey AS STRING), ' %', CAST(c_custkey AS STRING), ' ', c_mktsegment) AS line FROM customer) AS l", "SELECT CAST(substring(string_split(line, ' ')[1], 2) AS BIGINT) AS session, CAST(substring(string_split(line, ' ')[2], 2) AS BIGINT) AS pane, string_split(line, ' ')[3] AS title FROM (SELECT concat('$', CAST(c_nationkey AS STRING), ' %', CAST(c_custkey AS STRING), ' ', c_mktsegment) AS line FROM customer) AS l"),
}
