"""Search, token and link extraction, and ordered classification of text."""

from tallyrow.plans.query import Query

# What must be denied, what is sensitive, the token patterns, in order, and system paths.
DENY = [
    r"DROP\s+DATABASE",
    r"DROP\s+SCHEMA",
    r"DROP\s+TABLE\s+.*CASCADE",
    r"TRUNCATE\s+.*CASCADE",
    r"rm\s+-rf\s+/\z",
    r"rm\s+-rf\s+/\*",
    r"rm\s+-rf\s+~/?\z",
    r"rm\s+-rf\s+\$HOME",
    r"rm\s+-rf\s+\.\.\z",
    r"mkfs\s+/dev/",
    r"dd\s+if=.*\s+of=/dev/",
    r":\(\)\{\s*:\|:&\s*\};:",
    r"git\s+push\s+.*--force\s+.*\b(main|master)\b",
    r"git\s+push\s+.*-f\s+.*\b(main|master)\b",
]
SENSITIVE = [r"\bsudo\s+\S", r"git\s+push\b", r"git\s+reset\s+--hard", r"rm\s+-rf\s+\S", r"rm\s+-r\s+\S"]
TOKENS = {
    "markdown_url": r"\[[^]]*\]\(([^)]+)\)",
    "url": r"(?:https?://|git@|git://|ssh://|ftp://|file://)\S+",
    "diff_a": r"--- a/(\S+)",
    "diff_b": r"\+\+\+ b/(\S+)",
    "docker": r"sha256:([0-9a-f]{64})",
    "path": r"(?:[.\w\-@~]+)?(?:/+[.\w\-@]+)+",
    "color": r"#[0-9a-fA-F]{6}",
    "uuid": r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    "ipfs": r"Qm[0-9a-zA-Z]{44}",
    "sha": r"[0-9a-f]{7,40}",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "ipv6": r"[A-f0-9:]+:+[A-f0-9:]+[%\w\d]+",
    "address": r"0x[0-9a-fA-F]+",
    "number": r"[0-9]{4,}",
}
#: The patterns as one, tried in their order at each place.
ANY_TOKEN = "(?m)(" + "|".join(TOKENS.values()) + ")"
SYSTEM_PATHS = ["/etc/", "/usr/", "/bin/", "/sbin/", "/boot/", "/sys/", "/proc/"]


def classify(text: str) -> str:
    """SQL: deny, else allow-once, else allow-always."""
    any_of = lambda patterns: " OR ".join(f"MATCHES({text}, RX'(?i){p}')" for p in patterns)
    return f"CASE WHEN {any_of(DENY)} THEN 'deny' WHEN {any_of(SENSITIVE)} THEN 'allow-once' ELSE 'allow-always' END"


def token_kind(token: str) -> str:
    """SQL: the pattern a match of ANY_TOKEN is of. An earlier one that fitted all of it would have been taken for it."""
    return "CASE " + " ".join(f"WHEN MATCHES({token}, RX'\\A(?:{p})\\z') THEN '{k}'" for k, p in TOKENS.items()) + " END"


_COMMANDS = "(SELECT c.conv_id, c.turn, CASE (c.conv_id + c.turn) % 6 WHEN 0 THEN 'rm -rf /' WHEN 1 THEN 'sudo ' || c.text WHEN 2 THEN 'drop  database x' WHEN 3 THEN 'git push origin feature' WHEN 4 THEN 'git push --force origin main' ELSE c.text END AS text FROM conversations c) AS p"
_REPLIES = "(SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN ' allow_once ' WHEN 1 THEN 'Deny' WHEN 2 THEN 'allow always' WHEN 3 THEN 'allow' ELSE text END AS reply FROM conversations) AS p"
_TOOLS = """(SELECT conv_id, turn, concat('say <tool>{"name":"t', CAST(turn AS STRING), '","n":', CAST(conv_id AS STRING), '}</tool> and <tool>bad</tool> ', text) AS text FROM conversations) AS p"""

QUERIES = {
    # Non-overlapping literal matches of each line, and without regard to case.
    "literal_search": Query("SELECT doc_id, row, (length(line) - length(replace(line, 'the', ''))) IDIV 3 AS matches FROM {lines} AS l WHERE contains(line, 'the')"),
    "literal_search_any_case": Query("SELECT doc_id, row, (length(line) - length(replace(lower(line), 'the', ''))) IDIV 3 AS matches FROM {lines} AS l WHERE contains(lower(line), 'the')"),
    # The group that took part.
    "regex_search": Query("SELECT doc_id, row, regexp_extract(line, RX'(\\w+)@(\\w+)', 2) AS found FROM {lines} AS l WHERE MATCHES(line, RX'(\\w+)@(\\w+)')"),
    # How often each token pattern is the first of the alternation to match.
    "token_patterns": Query(
        f"SELECT doc_id, kind, CAST(size(filter(kinds, x -> x = kind)) AS BIGINT) AS n FROM (SELECT doc_id, transform(regexp_extract_all(text, RX'{ANY_TOKEN}', 0), t -> {token_kind('t')}) AS kinds FROM documents) AS m LATERAL VIEW explode(array_distinct(kinds)) AS kind",
        f"SELECT doc_id, kind, CAST(len(list_filter(kinds, lambda x: x = kind)) AS BIGINT) AS n FROM (SELECT doc_id, kinds, unnest(list_distinct(kinds)) AS kind FROM (SELECT doc_id, list_transform(regexp_extract_all(text, RX'{ANY_TOKEN}', 0), lambda t: {token_kind('t')}) AS kinds FROM documents) AS m) AS u",
    ),
    "url_tokens": Query(f"SELECT page_id, CAST(SIZE(regexp_extract_all(html, RX'{TOKENS['url']}', 0)) AS BIGINT) AS links FROM pages"),
    # Mail addresses as links.
    "mail_links": Query("SELECT doc_id, concat('mailto:', regexp_extract(text, RX'\\b\\w+@[\\w-]+(\\.[\\w-]+)+\\b', 0)) AS link FROM documents WHERE MATCHES(text, RX'\\b\\w+@[\\w-]+(\\.[\\w-]+)+\\b')"),
    # The first hit from an index on, and the last before one.
    "history_search": Query("SELECT doc_id, min(CASE WHEN row >= 2 THEN row END) AS forward, max(CASE WHEN row < 2 THEN row END) AS backward FROM {lines} AS l WHERE contains(line, 'en') GROUP BY doc_id"),
    # Host patterns, the first that matches decides.
    "host_match": Query("SELECT p_partkey, CASE WHEN MATCHES(p_brand, RX'^.*3$') THEN false WHEN MATCHES(p_brand, RX'^Brand.*$') THEN true ELSE false END AS matched FROM part"),
    # P17, P18; system paths of P20
    "risk_class": Query(f"SELECT conv_id, turn, {classify('text')} AS decision FROM {_COMMANDS}"),
    "reply_class": Query(f"SELECT conv_id, turn, CASE WHEN contains(upper(trim(reply)), 'DENY') THEN 'deny' WHEN contains(upper(trim(reply)), 'ALLOW_ONCE') OR contains(upper(trim(reply)), 'ALLOW ONCE') THEN 'allow-once' WHEN contains(upper(trim(reply)), 'ALLOW') THEN 'allow-always' ELSE 'allow-once' END AS decision FROM {_REPLIES}"),
    "system_path": Query(f"SELECT p_partkey, {' OR '.join(f"""STARTS(lower(path), '{x}')""" for x in SYSTEM_PATHS)} AS dangerous FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/ETC/x' WHEN 1 THEN '/home/y' ELSE '/proc/1' END AS path FROM part) AS p"),
    # Escape sequences removed.
    "strip_escapes": Query("SELECT doc_id, REPLACE_ALL(concat(chr(27), '[31m', text, chr(27), '[0m'), RX'\\x1b\\[[0-9;?]*[A-Za-z]', '') AS plain FROM documents"),
    # P22
    "blank_lines": Query("SELECT doc_id, count(*) AS lines, CAST(sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank FROM {lines} AS l GROUP BY doc_id"),
    # P23
    "user_input": Query("SELECT event_id, event_type IN ('click', 'purchase') AS is_input FROM events"),
    # P25: calls between tags whose JSON has a name.
    "tool_calls": Query(
        f"SELECT conv_id, turn, get_json_object(call, '$.name') AS name FROM (SELECT conv_id, turn, explode(regexp_extract_all(text, RX'(?s)<tool>(.*?)</tool>', 1)) AS call FROM {_TOOLS}) AS c WHERE get_json_object(call, '$.name') IS NOT NULL",
        f"SELECT conv_id, turn, json_extract_string(call, '$.name') AS name FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?s)<tool>(.*?)</tool>', 1)) AS call FROM {_TOOLS}) AS c WHERE json_valid(call) AND json_extract_string(call, '$.name') IS NOT NULL",
    ),
    # At most 50 lines overall, in order of file and line.
    "grep": Query("SELECT concat(CAST(doc_id AS STRING), ':', CAST(row + 1 AS STRING), ': ', line) AS hit FROM {lines} AS l WHERE MATCHES(line, RX'[0-9]{3}') ORDER BY doc_id, row LIMIT 50"),
    # Last and first rows.
    "last_lines": Query("SELECT doc_id, row, rtrim(line) AS line FROM (SELECT doc_id, row, line, row_number() OVER (PARTITION BY doc_id ORDER BY row DESC) AS rn FROM {lines} AS l) AS x WHERE rn <= 3"),
    "first_lines": Query("SELECT doc_id, row + 1 AS number, line FROM {lines} AS l WHERE row < 500"),
    "remaining_lines": Query("SELECT doc_id, greatest(count(*) - 500, 0) AS more FROM {lines} AS l GROUP BY doc_id"),
    # T06, in its documented meaning: whole lines until the limit is reached.
    "search_limit": Query("SELECT doc_id, row, n FROM (SELECT doc_id, row, n, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, row, CAST(length(line) - length(replace(line, 'e', '')) AS BIGINT) AS n FROM {lines} AS l) AS y WHERE n > 0) AS x WHERE before < 40"),
    # A range of rows, clamped.
    "row_range": Query("SELECT doc_id, row, line FROM {lines} AS l WHERE row BETWEEN greatest(-3, 0) AND 4"),
    # F04, F10
    "white_space": Query("SELECT p_partkey, MATCHES(p_name, RX'^\\s*$') AS white FROM part"),
    "split_lines": Query("SELECT doc_id, count(*) AS lines FROM {lines} AS l GROUP BY doc_id"),
    # sizes in steps of 1024.
    "human_size": Query("SELECT o_orderkey, CASE WHEN b < 1024 THEN concat(CAST(b AS STRING), ' B') WHEN b < 1048576 THEN concat(CAST(CAST(b / 1024.0 AS DECIMAL(18, 1)) AS STRING), ' KB') WHEN b < 1073741824 THEN concat(CAST(CAST(b / 1048576.0 AS DECIMAL(18, 1)) AS STRING), ' MB') ELSE concat(CAST(CAST(b / 1073741824.0 AS DECIMAL(18, 1)) AS STRING), ' GB') END AS size FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 10000 ELSE 0 END + o_orderkey % 1000 AS b FROM orders) AS o"),
    # F20, F21
    "summary": Query("SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN concat(substring(text, 1, 57), '...') ELSE text END AS summary FROM conversations"),
    "sigil_number": Query("SELECT c_custkey, TRY_CAST(substring(concat('%', CAST(c_custkey AS STRING)), 2) AS BIGINT) AS id FROM customer"),
    "status_string": Query("SELECT event_id, concat(event_type, ' (', CAST(user_id AS STRING), ')') AS status FROM events"),
    # V03, V08, V09, V12
    "json_key": Query("SELECT get_json_object(props, '$.k') AS k, count(*) AS n FROM events GROUP BY get_json_object(props, '$.k')", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL"),
    "coerce_integer": Query("SELECT event_id, CASE WHEN value = floor(value) THEN CAST(value AS BIGINT) END AS whole, CAST(event_id AS DOUBLE) AS real FROM events"),
    "content_id": Query("SELECT DISTINCT sha2(text, 256) AS id FROM documents", "SELECT DISTINCT sha256(text) AS id FROM documents"),
}
