"""DuckDB SQL for those registered queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""

#: Patterns as the contract gives them (RE2 needs neither guards nor possessive repetition).
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", "len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 14 AND 19 AND luhn(regexp_replace(m, '[^0-9]', '', 'g'))"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15"),
}


def _spans(no: int, name: str, pattern: str, valid: str) -> str:
    luhn = "(list_sum(list_transform(range(0, {n}), lambda i: CASE WHEN i % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)) % 10 = 0)"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    valid = valid.replace(f"luhn({digits})", luhn.format(n=f"len({digits})", d=f"CAST(substr({digits}, CAST(len({digits}) - i AS BIGINT), 1) AS INT)"))
    return f"""SELECT doc_id, {no} AS kind_no, '{name}' AS kind, start, start + length(m) AS stop FROM (
    SELECT doc_id, m, CAST(coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT doc_id, pieces, found, unnest(found) AS m, generate_subscripts(found, 1) AS i FROM (
        SELECT doc_id, string_split_regex(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}') AS found FROM d))) WHERE {valid}"""


#: The added kinds. RE2 has no look-around: both patterns take the character after a match as well, and the one before it must not be of the same kind.
_ADDED = {
    "iban": ("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"\b", "[A-Za-z0-9]", """length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(
      list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END),
      lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97) = 1"""),
    "ssn": ("[0-9]{3}-[0-9]{2}-[0-9]{4}", "(?:^|[^0-9-])", "[0-9-]", r"""NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')
      AND regexp_matches(lower(right(before, 40) || ' ' || left(after, 40)), '\bssn\b|social security')"""),
}


def _added(no: int, name: str, pattern: str, front: str, beside: str, valid: str) -> str:
    """Places of the strings that match somewhere in a text, each occurrence with nothing of its kind beside it."""
    return f"""SELECT doc_id, {no} AS kind_no, '{name}' AS kind, start, CAST(start + length(m) AS BIGINT) AS stop FROM (
    SELECT doc_id, m, start, left(t, start) AS before, substr(t, start + length(m) + 1) AS after FROM (
      SELECT doc_id, t, m, unnest(list_transform(range(1, len(cuts)), lambda i: CAST(list_sum(list_transform(cuts[1:i], lambda x: length(x))) + (i - 1) * length(m) AS BIGINT))) AS start
      FROM (SELECT doc_id, t, m, string_split(t, m) AS cuts FROM (SELECT DISTINCT doc_id, t, unnest(regexp_extract_all(t, '{front}({pattern})(?:[^{beside[1:]}|$)', 1)) AS m FROM d WHERE regexp_matches(t, '{pattern}')))))
    WHERE NOT regexp_matches(right(before, 1), '^{beside}$') AND NOT regexp_matches(left(after, 1), '^{beside}$') AND {valid}"""


_IBAN, _SSN = (_added(no, k, *v) for no, (k, v) in enumerate(_ADDED.items(), 4))
_BRANCHES = "\nUNION ALL ".join(_spans(no, k, *v) for no, (k, v) in enumerate(_KINDS.items()))
PERSONAL_DATA = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_BRANCHES}),
extra AS ({_IBAN} UNION ALL {_SSN}),
listed AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) AS s,
    count(*) FILTER (kind = 'email') AS e, count(*) FILTER (kind = 'ip') AS i, count(*) FILTER (kind = 'card') AS c, count(*) FILTER (kind = 'phone') AS p FROM base GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) AS s FROM (FROM base UNION ALL FROM extra) GROUP BY doc_id)
SELECT d.doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone,
    sha256(coalesce(listed.s, '')) AS base_sha256, coalesce(every.s, '') AS spans
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN every USING (doc_id)
"""

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DECONTAMINATION = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format(_LOWER)} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
found AS (SELECT DISTINCT doc_id, i, windows.n, item FROM places JOIN windows ON windows.n = places.n AND windows.s = array_to_string(places.w[i:i + places.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII string, bit by bit."""
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: {byte}))"


CONVERSATION_TRIE = f"""
WITH own AS (SELECT conv_id, list(struct_pack(id := sha256(strlen(r) || ':' || r || t), n := strlen(t)) ORDER BY turn NULLS FIRST, r, sha256(strlen(r) || ':' || r || t)) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
rebuilt AS (SELECT c.conv_id, coalesce(b.turns, [])[:h] || c.turns[h + 1:] AS turns
  FROM (SELECT *, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own) c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (SELECT conv_id, d AS depth, d = len(turns) AS ends, CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS n,
    sha256(array_to_string(list_transform(turns[:d], lambda x: x.id), '')) AS p, sha256(array_to_string(list_transform(turns[:d - 1], lambda x: x.id), '')) AS up
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT p, depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(n) AS own_tokens,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY p, depth),
kids AS (SELECT up AS p, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up, depth),
below AS (SELECT a.p, a.depth, sum(n.own_tokens) AS saved_tokens, count(*) FILTER (k.p IS NULL) AS n_leaves
  FROM nodes n JOIN prefixes a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN kids k ON k.p = n.p AND k.depth = n.depth GROUP BY a.p, a.depth)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.p = n.p AND b.depth = n.depth LEFT JOIN kids k ON k.p = n.p AND k.depth = n.depth LEFT JOIN nodes u ON u.p = n.up AND u.depth = n.depth - 1
"""


def _best(*ways: str) -> str:
    """The cheapest of (cost, letters, repaired turns), of equally cheap ones the one with the least letters."""
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x.cost IS NOT NULL))[1]"


def _way(tail: str, cost: str, letter: str, said: str | None = None) -> str:
    turns = f"[{said}] || {tail}.turns" if said else f"{tail}.turns"
    return f"struct_pack(cost := {tail}.cost + {cost}, letters := '{letter}' || {tail}.letters, turns := {turns})"


def _step() -> str:
    """Backwards over rows: best tails from each state (q0 at the start, q1 after s, q2 after u, q3 after a) before the row, given those behind it."""
    delete = lambda q: _way(f"s.{q}", "2", "D")  # noqa: E731
    keep = lambda q, i, to: _way(f"s.{to}", f"CASE WHEN fit AND initial = '{i}' THEN 5 * short END", "K", "r || ':' || t")  # noqa: E731
    rerole = lambda q, role, to: _way(f"s.{to}", "CASE WHEN fit THEN 1 + 5 * short END", "R", f"'{role}:' || t")  # noqa: E731
    return ", ".join(
        f"{_best(*ways)} AS {q}"
        for q, ways in {
            "p0": [delete("q0"), keep("q0", "s", "q1"), keep("q0", "u", "q2"), rerole("q0", "user", "q2")],
            "p1": [delete("q1"), keep("q1", "u", "q2"), rerole("q1", "user", "q2")],
            "p2": [delete("q2"), keep("q2", "a", "q3"), rerole("q2", "assistant", "q3")],
            "p3": [delete("q3"), keep("q3", "u", "q2"), rerole("q3", "user", "q2")],
        }.items()
    )


_INSERTED = (  # up to two turns in a row pay; each line needs those above it
    f"{_best('p2', _way('p3', '5', 'I', chr(39) + 'assistant:' + chr(39)))} AS q2, p0, p1, p3",
    f"q2, {_best('p0', _way('q2', '5', 'I', chr(39) + 'user:' + chr(39)))} AS q0, {_best('p1', _way('q2', '5', 'I', chr(39) + 'user:' + chr(39)))} AS q1, {_best('p3', _way('q2', '5', 'I', chr(39) + 'user:' + chr(39)))} AS q3",
)
_NONE = "struct_pack(cost := CAST({} AS BIGINT), letters := '{}', turns := {})"
TURN_REPAIR = rf"""
WITH RECURSIVE plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS how FROM conversations),
rows_ AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE r END AS r, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS t, unnest(range(0, CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS again FROM plain WHERE how > 0),
placed AS (SELECT *, left(r, 1) AS initial, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, r, t ORDER BY turn NULLS FIRST, again) AS nth,
    right(rtrim(t, E' 	

'), 1) AS last, lag(left(r, 1)) OVER w AS before FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(strlen(r) || ':' || r || t), again)),
judged AS (SELECT *, last = '' AS blank, last <> '' AND nth > 1 AS duplicate, last NOT IN ('', '.', '!', '?') AND nth = 1 AS truncated FROM placed),
prices AS (
  SELECT conv_id, n + 1 AS i, {_NONE.format(0, "", "CAST([] AS VARCHAR[])")} AS q0, {_NONE.format(10, "II", "['user:', 'assistant:']")} AS q1, {_NONE.format(5, "I", "['assistant:']")} AS q2, {_NONE.format(0, "", "CAST([] AS VARCHAR[])")} AS q3 FROM judged WHERE i = n
  UNION ALL
  SELECT conv_id, i, q0, q1, q2, q3 FROM (SELECT conv_id, i, {_INSERTED[1]} FROM (SELECT conv_id, i, {_INSERTED[0]} FROM (
    SELECT s.conv_id, j.i, {_step()} FROM prices s JOIN (SELECT *, NOT blank AND NOT duplicate AS fit, CASE WHEN truncated THEN 1 ELSE 0 END AS short FROM judged) j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.i - 1)))),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(q0.cost, 0) AS cost, coalesce(q0.letters, '') AS audit, sha256(coalesce(array_to_string(q0.turns, E'
'), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN prices p ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.i = 1
"""

SQL = {
    "op4_benchmark_decontamination": DECONTAMINATION,
    "op8_exact_dedup": EXACT_DEDUP,
    "op10_personal_data": PERSONAL_DATA,
    "op11_burst_trie": CONVERSATION_TRIE,
    "op13_turn_repair": TURN_REPAIR,
}
