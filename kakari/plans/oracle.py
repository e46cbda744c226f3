"""SQL for DuckDB that gives the rows of plans.queries, built from a few shared table expressions."""

from __future__ import annotations

from kakari.functions import text as T
from kakari.functions.patterns import ASCII_PUNCTUATION, CASE, CLOSE, DYNAMIC, IPA, JUMAN, NOUN, OPEN, PARTICLE, SYMBOL, UNIDIC, VERB, PosSet
from kakari.operators.sequence import CHUNK_TEMPLATES, ENTITY_TEMPLATES
from kakari.operators.tokens import FUNCTION_WORDS, VERBAL
from kakari.plans.queries import ASCII, STEPS, WIDE


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(c: str) -> str:
    for key, to in T.PAIRS.items():
        c = f"replace({c}, {quoted(key)}, {quoted(to)})"
    c = f"translate({c}, {quoted(''.join(T.SINGLES))}, {quoted(''.join(T.SINGLES.values()))})"
    return f"replace(replace({c}, '　', '___'), ' ', '___')"


_CSV = """(CASE WHEN regexp_matches(surface, '[,"]') THEN '"' || replace(surface, '"', '""') || '"' ELSE surface END)"""
_POS = f"""CASE WHEN regexp_full_match(surface, '[0-9]+') THEN '{NOUN},数,*,*,*,*,' || surface || ',' || surface
  WHEN lower(surface) IN ({', '.join(map(quoted, FUNCTION_WORDS))}) THEN '{PARTICLE},格助詞,一般,*,*,*,' || lower(surface) || ',' || surface
  WHEN surface IN ('(', '[', '{{', '<') THEN '{SYMBOL},括弧開,*,*,*,*,' || {_CSV} || ',' || {_CSV}
  WHEN surface IN (')', ']', '}}', '>') THEN '{SYMBOL},括弧閉,*,*,*,*,' || {_CSV} || ',' || {_CSV}
  WHEN NOT regexp_matches(surface, '^[A-Za-zÀ-ɏ]') THEN '{SYMBOL},一般,*,*,*,*,' || {_CSV} || ',' || {_CSV}
  WHEN length(surface) > 4 AND regexp_matches(surface, '(?:{'|'.join(VERBAL)})$') THEN '{VERB},自立,*,*,一段,基本形,' || lower(surface) || ',' || surface
  ELSE '{NOUN},一般,*,*,*,*,' || lower(surface) || ',' || surface END"""

_LINES = """{name}sent AS MATERIALIZED (SELECT {key} AS doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS line, unnest(l) AS sentence FROM (SELECT {key}, string_split(text, chr(10)) AS l FROM {table}))"""
_TOKENS = f"""{{name}}tk AS MATERIALIZED (
  SELECT *, CAST(sum(CAST(b AS INTEGER)) OVER (PARTITION BY doc_id, line ORDER BY i) - 1 AS INTEGER) AS chunk_id FROM (
  SELECT *, i = 0 OR (NOT part AND lag(part) OVER (PARTITION BY doc_id, line ORDER BY i)) AS b FROM (
  SELECT *, {CASE.sql('feature')} AS part, count(*) OVER (PARTITION BY doc_id, line) AS n_tok, {norm('surface')} AS norm FROM (
  SELECT *, {_POS} AS feature FROM (
  SELECT doc_id, line, unnest(w) AS surface, CAST(unnest(range(0, len(w))) AS INTEGER) AS i FROM (
  SELECT doc_id, line, regexp_extract_all(sentence, '[A-Za-zÀ-ɏ]+|[0-9]+|[^ \\t\\r\\n]') AS w FROM {{name}}sent))))))"""
def _chunks(ps: PosSet) -> str:
    func = "CASE WHEN f0 < head_pos THEN head_pos ELSE f0 END" if ps.func_after_head else "f0"
    return f"""{{name}}ch AS MATERIALIZED (
  SELECT *, {func} AS func_pos, CAST(count(*) OVER (PARTITION BY doc_id, line) AS INTEGER) AS n FROM (
  SELECT doc_id, line, chunk_id, min(i) AS token_pos, CAST(count(*) AS INTEGER) AS token_size, coalesce(max(i) FILTER ({ps.head.sql('feature')}), min(i)) - min(i) AS head_pos,
    coalesce(max(i) FILTER ({ps.func.sql('feature')}), min(i)) - min(i) AS f0 FROM {{name}}tk GROUP BY ALL))"""


def base(upto: str = "chunks", name: str = "", table: str = "documents", key: str = "doc_id", ps: PosSet = IPA) -> str:
    parts = [_LINES.format(name=name, table=table, key=key)]
    if upto != "lines":
        parts.append(_TOKENS.replace("{name}", name))
    if upto == "chunks":
        parts.append(_chunks(ps).replace("{name}", name))
    return ", ".join(parts)


_FIELDS = """regexp_extract_all(feature || ',', '("[^"]*(?:""[^"]*)*"|[^,]*),', 1)"""


def _token_features(header: str, t: str, n: int = 4) -> str:
    """The features of one token, as a list; symbols' quoted fields come after the levels."""
    levels = f"list_filter(string_split({t}.feature, ',')[1:{n}], lambda x: x <> '*')"
    form = f"string_split({t}.feature, ',')[{n + 2}]"
    return f"""list_concat(['{header}S:' || {t}.norm], list_transform({levels}, lambda x, k: '{header}P' || (k - 1) || ':' || x), CASE WHEN {form} = '*' THEN [] ELSE ['{header}F:' || {form}] END)"""


def features(name: str = "", n: int = 4) -> str:
    said = " UNION ALL ".join(
        f"SELECT doc_id, line, chunk_id, i, {r} AS r, [{', '.join(quoted(n) + ' || norm' if n.endswith(':') else quoted(n) for n in names)}] AS f FROM {name}tk WHERE {test}"
        for r, (test, names) in enumerate(((ASCII_PUNCTUATION.sql("norm", False), ("GPUNC:", "FPUNC:")), (OPEN.sql("norm", False), ("GOB:", "FOB:", "GOB:1", "FOB:1")), (CLOSE.sql("norm", False), ("GCB:", "FCB:", "GCB:1", "FCB:1")), ("part", ("FCASE:",))))
    )
    pos = f"array_to_string(list_filter(string_split(f.feature, ',')[1:{n}], lambda x: x <> '*'), '-')"
    form = f"string_split(f.feature, ',')[{n + 2}]"
    return f"""{name}said AS ({said}),
{name}own AS (SELECT c.doc_id, c.line, c.chunk_id, list_concat({_token_features('FH', 'h', n)}, {_token_features('FF', 'f', n)}, {_token_features('FL', 'l', n)}, {_token_features('FR', 'r', n)},
    ['LF:' || f.norm, 'RL:' || l.norm, 'RH:' || h.norm, 'RF:' || f.norm], CASE WHEN c.chunk_id = 0 THEN ['FBOS:1'] ELSE [] END, CASE WHEN c.chunk_id = c.n - 1 THEN ['FEOS:1'] ELSE [] END,
    CASE WHEN f.part THEN ['GCASE:' || f.norm] ELSE [] END, ['A:' || CASE WHEN {DYNAMIC.sql('f.feature')} THEN f.norm WHEN {form} <> '*' THEN {form} ELSE {pos} END]) AS fs
  FROM {name}ch c JOIN {name}tk h ON h.doc_id = c.doc_id AND h.line = c.line AND h.i = c.token_pos + c.head_pos JOIN {name}tk f ON f.doc_id = c.doc_id AND f.line = c.line AND f.i = c.token_pos + c.func_pos
  JOIN {name}tk l ON l.doc_id = c.doc_id AND l.line = c.line AND l.i = c.token_pos JOIN {name}tk r ON r.doc_id = c.doc_id AND r.line = c.line AND r.i = c.token_pos + c.token_size - 1),
{name}said_list AS (SELECT doc_id, line, chunk_id, flatten(list(f ORDER BY i, r)) AS fs FROM {name}said GROUP BY ALL),
{name}feat AS MATERIALIZED (SELECT o.doc_id, o.line, o.chunk_id, list_concat(coalesce(s.fs, []), o.fs)[1:128] AS fs FROM {name}own o LEFT JOIN {name}said_list s USING (doc_id, line, chunk_id))"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts) + " "


_RULE = "linked AS MATERIALIZED (SELECT *, CASE WHEN chunk_id = n - 1 THEN -1 ELSE least(chunk_id + 1 + token_size % {step}, n - 1) END AS link FROM ch)"
RULE = _RULE.format(step=2)
_SHOWN = "{name}shown AS MATERIALIZED (SELECT doc_id, line, list_distinct(flatten(list(fs))) AS fs FROM {name}feat GROUP BY ALL)"
MODEL = ", ".join([
    base("chunks", "b_", "benchmark", "item_id"), features("b_"), _SHOWN.format(name="b_"),
    "bdic AS MATERIALIZED (SELECT f AS feature, CAST(row_number() OVER (ORDER BY count(*) DESC, f) - 1 AS INTEGER) AS id FROM (SELECT unnest(fs) AS f FROM b_shown) GROUP BY f)",
    # a sentence without tokens is an instance without ids
    "svx AS MATERIALIZED (SELECT doc_id * 10000 + line AS sv_id, ((doc_id * 31 + line * 7) % 13 - 6) / 64.0::DOUBLE AS alpha, coalesce(x, []) AS x FROM b_sent LEFT JOIN (SELECT doc_id, line, list_sort(list(id)) AS x FROM (SELECT doc_id, line, unnest(fs) AS feature FROM b_shown) JOIN bdic USING (feature) GROUP BY ALL) USING (doc_id, line))",
    "svf AS MATERIALIZED (SELECT sv_id, alpha, unnest(x) AS id FROM svx)",
])
_INST = ", ".join([base(), features(), _SHOWN.format(name=""), "inst AS MATERIALIZED (SELECT doc_id, line, coalesce(x, []) AS x FROM sent LEFT JOIN (SELECT doc_id, line, list_sort(list(id)) AS x FROM (SELECT doc_id, line, unnest(fs) AS feature FROM shown) JOIN bdic USING (feature) GROUP BY ALL) USING (doc_id, line))"])
_W2 = """pw AS MATERIALIZED (SELECT a.id AS i, b.id AS j, count(*) AS n, sum(2 * a.alpha) AS w FROM svf a JOIN svf b ON a.sv_id = b.sv_id AND a.id < b.id GROUP BY ALL),
share AS (SELECT 0.01::DOUBLE * count(*) FILTER (alpha > 0) / count(*) AS up, -0.01::DOUBLE * count(*) FILTER (NOT alpha > 0) / count(*) AS down FROM svx),
w2 AS MATERIALIZED (SELECT i, j, n, w FROM pw, share WHERE (i < 20 AND j < 20) OR (n >= 2 AND (w <= down OR w >= up)))"""
_W1 = "w1 AS MATERIALIZED (SELECT id, sum(3 * alpha) AS w FROM svf GROUP BY id)"
_Q = """factor AS (SELECT max(a) / 1048575 AS factor FROM (SELECT abs(w) AS a FROM w1 UNION ALL SELECT abs(w) FROM w2)),
q AS MATERIALIZED (SELECT -1 AS i, -1 AS j, CAST(trunc(sum(alpha) / any_value(factor)) AS INTEGER) AS w FROM svx, factor
  UNION ALL SELECT id, -1, CAST(trunc(w / factor) AS INTEGER) AS t FROM w1, factor WHERE trunc(w / factor) <> 0
  UNION ALL SELECT i, j, CAST(trunc(w / factor) AS INTEGER) AS t FROM w2, factor WHERE trunc(w / factor) <> 0)"""


def _template(cells, names=("norm", "pos"), i: str = "i", n: str = "n_tok") -> str:
    def cell(offset, column):
        name = names[column]
        if offset == 0:
            return name
        beyond = f"'_B' || ({i} + {offset})" if offset < 0 else f"'_B+' || ({i} + {offset} - {n} + 1)"
        return f"coalesce({'lag' if offset < 0 else 'lead'}({name}, {abs(offset)}) OVER s, {beyond})"

    return " || '/' || ".join(cell(*c) for c in cells)


def _tags(turn: int) -> str:
    kind = f"CASE WHEN length(surface) % {turn + 2} = 0 THEN 'X' ELSE 'Y' END"
    raw = f"CASE WHEN length(surface) % 5 = {turn} THEN 'B-' || {kind} WHEN length(surface) % 5 = {turn + 1} THEN 'I-' || {kind} ELSE 'O' END"
    # an I becomes B at the start, or after an I of another type; a repaired B shields the next tag, so a run of I tags is gone through in order
    return f"""raw{turn} AS (SELECT doc_id, line, list({raw} ORDER BY i) AS t FROM tk GROUP BY ALL),
fixed{turn} AS (SELECT doc_id, line, list_reduce(list_transform(t, lambda x: [x]), lambda acc, x: list_append(acc, CASE WHEN x[1][1] = 'I' AND acc[-1][1] = 'I' AND x[1][3:] <> acc[-1][3:] THEN 'B' || x[1][2:] ELSE x[1] END)) AS f FROM (SELECT doc_id, line, list_concat([CASE WHEN t[1][1] = 'I' THEN 'B' || t[1][2:] ELSE t[1] END], t[2:]) AS t FROM raw{turn})),
tags{turn} AS MATERIALIZED (SELECT doc_id, line, CAST(unnest(range(0, len(f))) AS INTEGER) AS i, unnest(f) AS ne FROM fixed{turn}),
marks{turn} AS (SELECT *, CAST(ne[1] <> 'I' OR lag(ne[3:]) OVER s IS DISTINCT FROM ne[3:] AS INTEGER) AS m FROM tags{turn} WINDOW s AS (PARTITION BY doc_id, line ORDER BY i)),
islands{turn} AS (SELECT *, sum(m) OVER (PARTITION BY doc_id, line ORDER BY i) AS g FROM marks{turn}),
spans{turn} AS MATERIALIZED (SELECT doc_id, line, min_by(ne, i)[3:] AS category, min(i) AS start, CAST(count(*) AS INTEGER) AS size FROM islands{turn} GROUP BY doc_id, line, g HAVING min_by(ne, i)[1] = 'B')"""


def _rate(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part} * 100.0::DOUBLE / {whole} ELSE 0.0 END"


_PRF = f"{_rate('correct', 'n_system')} AS precision, {_rate('correct', 'n_gold')} AS recall, CASE WHEN n_system + n_gold > 0 THEN correct * 200.0::DOUBLE / (n_system + n_gold) ELSE 0.0 END AS f1"
_EMPTY = "(SELECT doc_id, line FROM sent ANTI JOIN tk USING (doc_id, line))"
_LATTICE = """lines AS (
  SELECT doc_id, line, i, 1 AS o, surface || chr(9) || feature || chr(10) AS l FROM tk
  UNION ALL SELECT doc_id, line, token_pos, 0, '* ' || chunk_id || ' ' || link || 'D ' || head_pos || '/' || func_pos || ' ' || {score} || chr(10) FROM {of})
SELECT doc_id, line, string_agg(l, '' ORDER BY i, o) || 'EOS' || chr(10) AS text FROM lines GROUP BY ALL UNION ALL SELECT doc_id, line, 'EOS' || chr(10) FROM """ + _EMPTY
_XML = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '\"', '&quot;'), '''', '&apos;'), '<', '&lt;'), '>', '&gt;')"

# The pass as a recursion whose every round tries one pair, or pushes the next chunk, in each sentence.
_PASS = """sizes AS (SELECT doc_id, line, list(token_size ORDER BY chunk_id) AS z, any_value(n) AS n FROM ch GROUP BY doc_id, line),
run AS (
  SELECT doc_id, line, z, n, 1 AS dst, [0] AS stack, -1 AS src, -1 AS linked, 0 AS latest FROM sizes
  UNION ALL
  SELECT doc_id, line, z, n, CASE WHEN ok AND len(stack) > 1 THEN dst ELSE dst + 1 END,
    CASE WHEN ok AND len(stack) > 1 THEN stack[2:] WHEN ok THEN [dst] ELSE list_prepend(dst, stack) END,
    CASE WHEN ok THEN stack[1] ELSE -1 END, CASE WHEN ok THEN dst ELSE -1 END, s
  FROM (SELECT *, dst = n - 1 OR s > 0 AS ok FROM (SELECT *, CASE WHEN dst = n - 1 THEN latest ELSE
    (7 * z[stack[1] + 1] + 13 * (z[stack[1] + 1] % 4) + 5 * (dst - stack[1]) + 3 * z[dst + 1]) % 11 - 5 END AS s FROM run WHERE dst < n))),
passed AS MATERIALIZED (SELECT doc_id, line, src AS chunk_id, linked AS link, latest AS score FROM run WHERE linked >= 0),
linked AS MATERIALIZED (SELECT ch.*, coalesce(p.link, -1) AS link, coalesce(p.score, 0) AS score FROM ch LEFT JOIN passed p USING (doc_id, line, chunk_id))"""


_PAIRS = """pairs AS MATERIALIZED (SELECT doc_id, line, chunk_id AS src, CAST(chunk_id + 1 AS INTEGER) AS dst FROM linked WHERE chunk_id < n - 1 UNION ALL SELECT doc_id, line, chunk_id, link FROM linked WHERE link > chunk_id + 1)"""


def oracle_sql() -> dict[str, str]:
    chunks, tokens, lines = base(), base("tokens"), base("lines")
    codes = "CASE " + " ".join(f"WHEN {' OR '.join(f'unicode(c) BETWEEN {a} AND {b}' for a, b in r)} THEN {k}" for k, r in T.CLASSES.items()) + f" ELSE {T.OTHER} END"
    shape = f"""SELECT doc_id, line, tok_id, CASE WHEN len(cs) > 1 AND cs[1] = {T.CAPALPHA} AND len(list_filter(cs[2:], lambda x: x <> {T.ALPHA})) = 0 THEN 'C' WHEN len(cs) = 1 THEN 'S' || cs[1]
      WHEN len(r) = 1 THEN 'M' || r[1] ELSE 'T' || r[-2] || '-' || r[-1] END AS shape FROM (
      SELECT *, list_filter(kept, lambda x, k: k = 1 OR x <> kept[k - 1]) AS r FROM (SELECT *, list_concat(cs[1:1], list_filter(cs[2:], lambda x: x <> {T.HYPHEN})) AS kept FROM (
      SELECT doc_id, line, i AS tok_id, list_transform(string_split(surface, ''), lambda c: {codes}) AS cs FROM tk)))"""
    strip = lambda x: f"""CASE WHEN {x}[1] = '"' THEN replace({x}[2:-2], '""', '"') ELSE {x} END"""
    feats = f"{chunks}, {features()}"
    gap = "'DIST:' || CASE WHEN dst - src = 1 THEN '1' WHEN dst - src <= 5 THEN '2-5' ELSE '6-' END"
    pick = lambda t, a, b: f"list_transform(list_filter({t}.fs, lambda x: x[1] = '{a}'), lambda x: '{b}' || x[2:])"
    between = lambda pairs: f"""roles AS MATERIALIZED (SELECT doc_id, line, chunk_id, {pick('feat', 'F', 'S')} AS s, {pick('feat', 'F', 'D')} AS d, {pick('feat', 'L', 'L')} AS l, {pick('feat', 'R', 'R')} AS r, {pick('feat', 'G', 'G')} AS g, {pick('feat', 'A', 'A')} AS a FROM feat),
      between AS MATERIALIZED (SELECT p.doc_id, p.line, src, dst, list_distinct(flatten(list(g))) AS g FROM (SELECT *, unnest(range(src + 1, dst)) AS k FROM {pairs}) p JOIN roles ON roles.doc_id = p.doc_id AND roles.line = p.line AND roles.chunk_id = k GROUP BY ALL)"""  # noqa: E731
    of_pair = lambda *more: f"""array_to_string(list_sort(list_distinct(list_concat([{gap.replace('src', 'p.src').replace('dst', 'p.dst')}], a.s, b.d, coalesce(l.l, []), coalesce(r.r, []), list_filter(coalesce(w.g, []), lambda x: x NOT IN ('GOB:1', 'GCB:1')), {''.join(x + ', ' for x in more)}
      [CASE WHEN list_contains(w.g, 'GOB:1') AND list_contains(w.g, 'GCB:1') THEN 'GBB:1' WHEN list_contains(w.g, 'GOB:1') THEN 'GOB:1' WHEN list_contains(w.g, 'GCB:1') THEN 'GCB:1' ELSE 'GNB:1' END]))), '|')"""  # noqa: E731
    pair = lambda t: f"{t}.doc_id = p.doc_id AND {t}.line = p.line AND {t}.src = p.src AND {t}.dst = p.dst"
    same = lambda t, k: f"{t}.doc_id = p.doc_id AND {t}.line = p.line AND {t}.chunk_id = {k}"
    joined = lambda pairs: f"""FROM {pairs} p JOIN roles a ON {same('a', 'p.src')} JOIN roles b ON {same('b', 'p.dst')} LEFT JOIN roles l ON {same('l', 'p.src - 1')} LEFT JOIN roles r ON {same('r', 'p.dst + 1')} LEFT JOIN between w ON {pair('w')}"""
    walk = f"""gold AS MATERIALIZED (SELECT doc_id, line, list(link ORDER BY chunk_id) AS g, any_value(n) AS n FROM linked GROUP BY doc_id, line HAVING any_value(n) >= 2),
      walk AS (SELECT doc_id, line, g, n, 1 AS nxt, [0] AS stack, -1 AS src, -1 AS dst, false AS label FROM gold
        UNION ALL SELECT doc_id, line, g, n, CASE WHEN ok AND len(stack) > 1 THEN nxt ELSE nxt + 1 END, CASE WHEN ok AND len(stack) > 1 THEN stack[2:] WHEN ok THEN [nxt] ELSE list_prepend(nxt, stack) END, stack[1], nxt, ok FROM (SELECT *, g[stack[1] + 1] = nxt AS ok FROM walk WHERE nxt < n - 1)),
      tried AS MATERIALIZED (SELECT doc_id, line, src, dst, CASE WHEN label THEN 1 ELSE -1 END AS label FROM walk WHERE src >= 0),
      {between('tried')}, kids AS MATERIALIZED (SELECT doc_id, line, link, chunk_id, a FROM linked JOIN roles USING (doc_id, line, chunk_id)),
      of_src AS MATERIALIZED (SELECT doc_id, line, link AS src, list_transform(flatten(list(a)), lambda x: 'a' || x[2:]) AS ks FROM kids GROUP BY ALL),
      of_dst AS MATERIALIZED (SELECT t.doc_id, t.line, src, dst, flatten(list(a)) AS kd FROM tried t JOIN kids k ON k.doc_id = t.doc_id AND k.line = t.line AND k.link = t.dst AND k.chunk_id > t.src GROUP BY ALL)
      SELECT p.doc_id, p.line, p.src, p.dst, label, {of_pair('coalesce(ks, [])', 'coalesce(kd, [])')} AS features {joined('tried')} LEFT JOIN of_src ON of_src.doc_id = p.doc_id AND of_src.line = p.line AND of_src.src = p.src LEFT JOIN of_dst ON {pair('of_dst')}"""
    tags = lambda ps: f"SELECT doc_id, line, chunk_id, '{ps.name}' AS tags, head_pos, {'greatest(head_pos, f0)' if ps.func_after_head else 'f0'} AS func_pos FROM (SELECT doc_id, line, chunk_id, coalesce(max(i) FILTER ({ps.head.sql('feature')}), min(i)) - min(i) AS head_pos, coalesce(max(i) FILTER ({ps.func.sql('feature')}), min(i)) - min(i) AS f0 FROM tk GROUP BY ALL)"
    marked = lambda ps: _with(base(ps=ps), features(n=ps.select_levels)) + "SELECT doc_id, line, chunk_id, array_to_string(list_sort(fs), '|') AS features FROM feat"
    pos = "array_to_string(list_filter(string_split(feature, ',')[1:4], lambda x: x <> '*'), '-')"
    numeral = f"starts_with(feature, '{IPA.numeral}')"
    entity = f"""shapes AS MATERIALIZED ({shape.replace('surface', 'norm')}),
      rows_ AS (SELECT *, row_number() OVER s - 1 AS row, count(*) OVER (PARTITION BY doc_id, line) AS n_rows FROM (SELECT tk.doc_id, tk.line, i, norm, {pos} AS pos, shape, {numeral} AND coalesce(lag({numeral}) OVER (PARTITION BY tk.doc_id, tk.line ORDER BY i), false) AS tail FROM tk JOIN shapes ON shapes.doc_id = tk.doc_id AND shapes.line = tk.line AND tok_id = i) WHERE NOT tail WINDOW s AS (PARTITION BY doc_id, line ORDER BY i))
      SELECT doc_id, line, CAST(row AS INTEGER) AS row, {' || chr(124) || '.join(f"{quoted(name + chr(58))} || {_template(cells, ('norm', 'shape', 'pos'), 'row', 'n_rows')}" for name, cells in ENTITY_TEMPLATES.items())} AS features FROM rows_ WINDOW s AS (PARTITION BY doc_id, line ORDER BY row)"""
    csv = """array_to_string(list_transform(fs, lambda x: CASE WHEN regexp_matches(x, '[,"]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END), ',')"""
    layers = f"""heads AS (SELECT doc_id, line, token_pos, 2 AS layer, '* ' || chunk_id || ' ' || link || 'D ' AS h FROM linked UNION ALL SELECT doc_id, line, token_pos, 3, '* ' || chunk_id || ' ' || link || 'D ' || head_pos || '/' || func_pos || ' 0.000000 ' || {csv} FROM linked JOIN feat USING (doc_id, line, chunk_id)),
      pieces AS (SELECT doc_id, line, layer, i, 1 AS o, surface || chr(9) || feature || chr(10) AS l FROM tk, (VALUES (1), (2), (3)) v(layer) UNION ALL SELECT doc_id, line, layer, token_pos, 0, h || chr(10) FROM heads)
      SELECT doc_id, line, layer, string_agg(l, '' ORDER BY i, o) || 'EOS' || chr(10) AS text FROM pieces GROUP BY ALL UNION ALL SELECT doc_id, line, layer, 'EOS' || chr(10) FROM {_EMPTY}, (VALUES (1), (2), (3)) v(layer)"""
    talk = ", ".join([
        base("chunks", "t_", "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"), features("t_"), _SHOWN.format(name="t_"),
        "told AS MATERIALIZED (SELECT doc_id, line, unnest(fs) AS feature FROM t_shown)",
        "mdic AS MATERIALIZED (SELECT feature, id FROM bdic UNION ALL SELECT feature, CAST((SELECT max(id) FROM bdic) + row_number() OVER (ORDER BY feature) AS INTEGER) FROM (SELECT DISTINCT feature FROM told ANTI JOIN bdic USING (feature)))",
    ])
    inst = f"{MODEL}, {_INST}"
    tag = "regexp_replace(regexp_replace(sentence, '[<>]', '', 'g'), '(^| )([A-Z][a-z]+)([ .,])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"
    align = """whole AS (SELECT doc_id, line, chunk_id, link, sum(length) OVER (PARTITION BY doc_id, line ORDER BY chunk_id) AS stop FROM (SELECT l.doc_id, l.line, l.chunk_id, l.link, sum(length(t.surface)) AS length FROM linked l JOIN tk t USING (doc_id, line, chunk_id) GROUP BY ALL)),
      pairs AS (SELECT doc_id, line, CAST(i // 2 AS INTEGER) AS tok_id, max(stop) AS stop FROM (SELECT doc_id, line, i, sum(length(surface)) OVER (PARTITION BY doc_id, line ORDER BY i) AS stop FROM tk) GROUP BY ALL),
      made AS MATERIALIZED (SELECT doc_id, line, CAST(row_number() OVER s - 1 AS INTEGER) AS new_id, link AS was, chunk_id AS src, coalesce(lag(tok_id) OVER s, -1) + 1 AS first_tok, tok_id FROM whole JOIN pairs USING (doc_id, line, stop) WINDOW s AS (PARTITION BY doc_id, line ORDER BY stop)),
      whither AS (SELECT m.doc_id, m.line, m.new_id, min(o.new_id) AS t FROM made m JOIN made o ON o.doc_id = m.doc_id AND o.line = m.line AND o.src >= m.was GROUP BY ALL)
      SELECT doc_id, line, new_id, CASE WHEN was = -1 THEN -1 ELSE t END AS link, 'D' AS kind, src, first_tok, tok_id - first_tok + 1 AS n_tokens FROM made LEFT JOIN whither USING (doc_id, line, new_id)"""
    em = "(length(surface) * 7 % 5)::DOUBLE AS b, (length(surface) * 3 % 7)::DOUBLE AS o"
    vit = f"""emit AS (SELECT doc_id, line, list({{'b': b, 'o': o}} ORDER BY i) AS e, count(*) AS n FROM (SELECT doc_id, line, i, {em} FROM tk) GROUP BY ALL),
      walk AS (SELECT doc_id, line, e, n, 1 AS k, e[1].b AS sb, e[1].o AS so, 'B' AS pb, 'I' AS po FROM emit
        UNION ALL SELECT doc_id, line, e, n, k + 1, greatest(sb + {STEPS[0][0]}, so + {STEPS[1][0]}) + e[k + 1].b, greatest(sb + {STEPS[0][1]}, so + {STEPS[1][1]}) + e[k + 1].o,
          CASE WHEN sb + {STEPS[0][0]} >= so + {STEPS[1][0]} THEN pb ELSE po END || 'B', CASE WHEN sb + {STEPS[0][1]} >= so + {STEPS[1][1]} THEN pb ELSE po END || 'I' FROM walk WHERE k < n),
      best AS (SELECT doc_id, line, string_split(CASE WHEN sb >= so THEN pb ELSE po END, '') AS y FROM walk WHERE k = n)
      SELECT doc_id, line, CAST(unnest(range(0, len(y))) AS INTEGER) AS tok_id, unnest(y) AS label FROM best"""
    depth = """up AS (SELECT doc_id, line, chunk_id, 0 AS depth FROM linked WHERE link = -1 UNION ALL SELECT l.doc_id, l.line, l.chunk_id, depth + 1 FROM up JOIN linked l ON l.doc_id = up.doc_id AND l.line = up.line AND l.link = up.chunk_id) SELECT doc_id, line, chunk_id, depth FROM up"""
    tree = f"""texts AS MATERIALIZED (SELECT l.doc_id, l.line, l.chunk_id, l.link, l.n, string_agg(t.surface, '' ORDER BY t.i) AS s FROM linked l JOIN tk t USING (doc_id, line, chunk_id) GROUP BY ALL),
      sized AS MATERIALIZED (SELECT *, 2 * length(s) - length(regexp_replace(s, '[^\\x00-\\x7F]', '', 'g')) AS w FROM texts),
      firsts AS (SELECT doc_id, line, link AS j, min(chunk_id) AS f FROM texts WHERE link >= 0 GROUP BY ALL),
      top AS (SELECT doc_id, line, max(w) AS m, max(n) AS n FROM sized GROUP BY ALL),
      firstlist AS MATERIALIZED (SELECT doc_id, line, list(f ORDER BY k.j) AS fs, any_value(m) AS m FROM (SELECT doc_id, line, m, unnest(range(0, n)) AS j FROM top) k LEFT JOIN firsts USING (doc_id, line, j) GROUP BY ALL),
      drawn AS (SELECT doc_id, line, chunk_id, repeat(' ', CAST(m - w + 2 * chunk_id AS BIGINT)) || s || array_to_string(list_transform(range(chunk_id + 1, n), lambda j: CASE WHEN link = j THEN '-D' WHEN fs[j + 1] < chunk_id THEN ' |' WHEN link > chunk_id AND link < j THEN '  ' ELSE '--' END), '') || chr(10) AS l FROM sized JOIN firstlist USING (doc_id, line))
      SELECT doc_id, line, string_agg(l, '' ORDER BY chunk_id) || 'EOS' || chr(10) AS text FROM drawn GROUP BY ALL UNION ALL SELECT doc_id, line, 'EOS' || chr(10) FROM {_EMPTY}"""
    xml = f"""lines AS (SELECT doc_id, line, i, 1 AS o, '  <tok id="' || i || '" feature="' || {_XML.format('feature')} || '">' || {_XML.format('surface')} || '</tok>' || chr(10) AS l FROM tk
      UNION ALL SELECT doc_id, line, token_pos, 0, ' <chunk id="' || chunk_id || '" link="' || link || '" rel="D" score="0.000000" head="' || (head_pos + token_pos) || '" func="' || (func_pos + token_pos) || '">' || chr(10) FROM linked
      UNION ALL SELECT doc_id, line, token_pos + token_size - 1, 2, ' </chunk>' || chr(10) FROM linked)
      SELECT doc_id, line, '<sentence>' || chr(10) || string_agg(l, '' ORDER BY i, o) || '</sentence>' || chr(10) AS text FROM lines GROUP BY ALL UNION ALL SELECT doc_id, line, '<sentence>' || chr(10) || '</sentence>' || chr(10) FROM {_EMPTY}"""
    conll = f"""rows AS (SELECT t.doc_id, t.line, t.i, (t.i + 1) || chr(9) || surface || chr(9) || {strip(f'{_FIELDS}[7]')} || chr(9) || string_split(feature, ',')[1] || chr(9) || {pos} || chr(9) || 'feature=' || feature
      || CASE WHEN t.i = l.token_pos THEN '|begin_chunk=1' ELSE '' END || CASE WHEN t.i = l.token_pos + l.head_pos THEN '|head=1' ELSE '' END || CASE WHEN t.i = l.token_pos + l.func_pos THEN '|func=1' ELSE '' END || chr(9)
      || CASE WHEN t.i = l.token_pos + l.token_size - 1 AND l.link >= 0 THEN h.token_pos + h.head_pos + 1 WHEN t.i + 2 = n_tok + 1 THEN 0 ELSE t.i + 2 END || chr(9) || CASE WHEN t.i = l.token_pos + l.token_size - 1 AND l.link >= 0 THEN 'D' ELSE '_' END || chr(9) || '_' || chr(9) || '_' || chr(10) AS r
      FROM tk t JOIN linked l USING (doc_id, line, chunk_id) LEFT JOIN linked h ON h.doc_id = l.doc_id AND h.line = l.line AND h.chunk_id = l.link)
      SELECT doc_id, line, string_agg(r, '' ORDER BY i) || chr(10) AS text FROM rows GROUP BY ALL UNION ALL SELECT doc_id, line, chr(10) FROM {_EMPTY}"""
    dep = f"""both_ AS (SELECT doc_id, line, chunk_id, n, CASE WHEN chunk_id = n - 1 THEN -1 ELSE least(chunk_id + 1 + token_size % 2, n - 1) END = CASE WHEN chunk_id = n - 1 THEN -1 ELSE least(chunk_id + 1 + token_size % 3, n - 1) END AS ok FROM ch),
      by_s AS (SELECT doc_id, line, bool_and(ok) AS whole, {', '.join(f'count(*) FILTER (chunk_id < n - {k} AND ok) AS correct{k}, count(*) FILTER (chunk_id < n - {k}) AS all{k}' for k in range(3))} FROM both_ GROUP BY ALL),
      total AS (SELECT {', '.join(f'CAST(sum({c}{k}) AS BIGINT) AS {c}{k}' for k in range(3) for c in ('correct', 'all'))}, count(*) FILTER (whole) AS correct_sentences, count(*) AS all_sentences FROM by_s)
      SELECT *, {', '.join(f'{_rate(f"correct{k}", f"all{k}")} AS rate{k}' for k in range(3))}, {_rate('correct_sentences', 'all_sentences')} AS sentence_rate FROM total"""
    evc = f"""other AS (SELECT doc_id, line, min(i) AS token_pos, count(*) AS token_size FROM (SELECT doc_id, line, i, sum(CAST(i = 0 OR part AS INTEGER)) OVER (PARTITION BY doc_id, line ORDER BY i) AS g FROM tk) GROUP BY doc_id, line, g),
      c AS (SELECT count(*) FILTER (a.token_size = b.token_size) AS correct, count(a.token_size) AS n_system, count(b.token_size) AS n_gold FROM ch a FULL JOIN other b ON a.doc_id = b.doc_id AND a.line = b.line AND a.token_pos = b.token_pos)
      SELECT *, {_PRF} FROM c"""
    evn = f"""p AS (SELECT a.category AS mine, b.category AS rig FROM spans1 a FULL JOIN spans2 b ON a.doc_id = b.doc_id AND a.line = b.line AND a.start = b.start AND a.size = b.size),
      f AS (SELECT mine AS category, CAST(mine = rig AND rig IS NOT NULL AS INTEGER) AS c, 1 AS s, 0 AS g FROM p WHERE mine IS NOT NULL UNION ALL SELECT rig, 0, 0, 1 FROM p WHERE rig IS NOT NULL),
      k AS (SELECT coalesce(category, '(all)') AS category, sum(c) AS correct, sum(s) AS n_system, sum(g) AS n_gold FROM f GROUP BY ROLLUP (category)
        UNION ALL SELECT '(any)', count(*) FILTER (mine IS NOT NULL AND rig IS NOT NULL), count(mine), count(rig) FROM p)
      SELECT category, CAST(coalesce(correct, 0) AS BIGINT) AS correct, CAST(coalesce(n_system, 0) AS BIGINT) AS n_system, CAST(coalesce(n_gold, 0) AS BIGINT) AS n_gold, {_PRF} FROM k"""
    return {
        "read_sentences": _with(lines) + "SELECT * FROM sent",
        "tokens_pos": _with(tokens) + "SELECT doc_id, line, i AS tok_id, surface, feature FROM tk",
        "normalize_width": _with(lines) + f"SELECT doc_id, line, {norm(f'translate(sentence, {quoted(ASCII)}, {quoted(WIDE)})')} AS norm FROM sent",
        "display_width": _with(lines) + "SELECT doc_id, line, CAST(2 * length(sentence) - length(regexp_replace(sentence, '[^\\x00-\\x7F]', '', 'g')) AS INTEGER) AS width FROM sent",
        "char_shape": _with(tokens) + shape,
        "csv_features": _with(tokens) + f"SELECT doc_id, line, i AS tok_id, CAST(len({_FIELDS}) AS INTEGER) AS n_fields, {strip(f'{_FIELDS}[7]')} AS lemma, {pos} AS pos, nullif(string_split(feature, ',')[6], '*') AS form, feature AS csv FROM tk",
        "chunk_spans": _with(chunks) + "SELECT doc_id, line, chunk_id, token_pos, token_size FROM ch",
        "head_func": _with(chunks) + "SELECT doc_id, line, chunk_id, head_pos, func_pos FROM ch",
        "chunk_features": _with(feats) + "SELECT doc_id, line, chunk_id, array_to_string(list_sort(fs), '|') AS features FROM feat",
        "distance_bucket": _with(chunks, _PASS, _PAIRS, recursive=True) + f"SELECT doc_id, line, src, dst, {gap} AS bucket FROM pairs",
        "pair_features": _with(feats, _PASS, _PAIRS, recursive=True) + f", {between('pairs')} SELECT p.doc_id, p.line, p.src, p.dst, {of_pair()} AS features {joined('pairs')}",
        "feature_dictionary": _with(feats, _SHOWN.format(name="")) + "SELECT f AS feature, CAST(row_number() OVER (ORDER BY count(*) DESC, f) - 1 AS INTEGER) AS id, count(*) AS n FROM (SELECT unnest(fs) AS f FROM shown) GROUP BY f",
        "feature_ids": _with(inst) + "SELECT doc_id, line, array_to_string(x, ',') AS x FROM inst",
        "active_features": _with(MODEL) + "SELECT feature, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS id FROM bdic SEMI JOIN (SELECT id FROM svf WHERE alpha <> 0 GROUP BY id HAVING count(*) >= 2) USING (id)",
        "reranked": _with(MODEL) + "SELECT feature, CAST(row_number() OVER (ORDER BY coalesce(c, 0) DESC, id DESC) - 1 AS INTEGER) AS id FROM bdic LEFT JOIN (SELECT id, count(*) AS c FROM svf WHERE alpha > 0 GROUP BY id) USING (id)",
        "sorted_instances": _with(MODEL) + "SELECT CAST(row_number() OVER (ORDER BY x, sv_id) - 1 AS INTEGER) AS sv_id, alpha, array_to_string(x, ',') AS x FROM svx",
        "kernel_score": _with(inst) + """, ids AS (SELECT doc_id, line, unnest(x) AS id FROM inst), met AS (SELECT doc_id, line, sv_id, alpha, count(*) AS s FROM ids JOIN svf USING (id) GROUP BY ALL),
          more AS (SELECT doc_id, line, sum(alpha * s * (s + 2)) AS m FROM met GROUP BY ALL)
          SELECT doc_id, line, (SELECT sum(alpha) FROM svx) + coalesce(m, 0) AS score FROM inst LEFT JOIN more USING (doc_id, line)""",
        "pke_w1": _with(MODEL, _W1) + "SELECT id, w FROM w1",
        "pke_w2": _with(MODEL, _W2) + "SELECT i, j, n, w FROM w2",
        "pke_quantise": _with(MODEL, _W1, _W2, _Q) + "SELECT i, j, w FROM q",
        "pke_score": _with(inst, _W1, _W2, _Q) + """, ids AS (SELECT doc_id, line, unnest(x) AS id FROM inst),
          parts AS (SELECT doc_id, line, w FROM ids JOIN q ON q.i = ids.id AND q.j = -1 UNION ALL SELECT a.doc_id, a.line, w FROM ids a JOIN ids b ON a.doc_id = b.doc_id AND a.line = b.line AND a.id < b.id JOIN q ON q.i = a.id AND q.j = b.id),
          sums AS (SELECT doc_id, line, sum(w) AS s FROM parts GROUP BY ALL)
          SELECT doc_id, line, CAST(q.w + coalesce(s, 0) AS BIGINT) AS score, (q.w + coalesce(s, 0)) * factor AS scaled FROM inst LEFT JOIN sums USING (doc_id, line), q, factor WHERE q.i = -1""",
        "shift_reduce_links": _with(chunks, _PASS, recursive=True) + "SELECT doc_id, line, chunk_id, link, CAST(score AS INTEGER) AS score FROM linked",
        "tree_depth": _with(chunks, RULE, depth, recursive=True),
        "format_lattice": _with(chunks, RULE, _LATTICE.format(score="'0.000000'", of="linked")),
        "format_tree": _with(chunks, RULE, tree),
        "format_xml": _with(chunks, RULE, xml),
        "format_conll": _with(chunks, RULE, conll),
        "read_layer_blocks": _with(chunks, RULE) + "SELECT doc_id, line, chunk_id, true AS is_valid, link, head_pos, func_pos, token_pos, token_size FROM linked",
        "iob_repair": _with(tokens, _tags(1)) + "SELECT doc_id, line, i AS tok_id, ne FROM tags1",
        "iob_spans": _with(tokens, _tags(1)) + "SELECT doc_id, line, category, start, size FROM spans1",
        "numeral_runs": _with(tokens) + f"SELECT doc_id, line, CAST(row_number() OVER (PARTITION BY doc_id, line ORDER BY i) - 1 AS INTEGER) AS row, i AS tok_id, norm AS surface, pos FROM (SELECT *, {pos} AS pos, starts_with(feature, '{IPA.numeral}') AND coalesce(lag(starts_with(feature, '{IPA.numeral}')) OVER (PARTITION BY doc_id, line ORDER BY i), false) AS tail FROM tk) WHERE NOT tail",
        "eval_dep": _with(chunks, dep),
        "eval_chunk": _with(chunks, evc),
        "eval_ne": _with(tokens, _tags(1), _tags(2), evn),
        "legacy_to_csv": _with(tokens) + "SELECT doc_id, line, i AS tok_id, CASE WHEN contains(l, 'EOS') THEN 'EOS' WHEN l[1] = '*' THEN l ELSE surface || chr(9) || p || ',' || q || ',*,*,*,x,' || surface || ',' || lower(surface) || chr(9) END AS csv FROM (SELECT *, surface || chr(9) || lower(surface) || chr(9) || surface || chr(9) || p || '-' || q || chr(9) || chr(9) || 'x' AS l FROM (SELECT *, split_part(feature, ',', 1) AS p, split_part(feature, ',', 2) AS q FROM tk))",
        "blank_to_csv": _with(tokens) + "SELECT doc_id, line, i AS tok_id, CASE WHEN surface[1] = '#' THEN NULL WHEN surface[1] = '*' THEN surface || ' ' || lower(surface) || ' * ' || p || ' a b *' ELSE surface || chr(9) || p || ',a,b,*,' || surface || ',' || lower(surface) || ',*' END AS csv FROM (SELECT *, split_part(feature, ',', 1) AS p FROM tk)",
        "inline_to_iob": _with(lines) + f"""SELECT doc_id, line, CAST(unnest(range(0, len(w))) AS INTEGER) AS tok_id, unnest(list_transform(w, lambda x: regexp_replace(x, '[' || chr(1) || chr(2) || ']', '', 'g'))) AS surface, unnest(list_transform(w, lambda x: CASE WHEN x[1] = chr(1) THEN 'B-PERSON' ELSE 'O' END)) AS ne
          FROM (SELECT doc_id, line, regexp_extract_all({tag}, chr(1) || '[A-Za-z]+' || chr(2) || '|[A-Za-zÀ-ɏ]+|[0-9]+|[^ \\t\\r\\n]') AS w FROM sent)""",
        "realign_chunks": _with(chunks, RULE, align),
        "crf_features": _with(tokens) + f"SELECT doc_id, line, i AS tok_id, {' || chr(124) || '.join(f'{quoted(name + chr(58))} || {_template(cells)}' for name, cells in CHUNK_TEMPLATES.items())} AS features FROM (SELECT *, {pos} AS pos FROM tk) WINDOW s AS (PARTITION BY doc_id, line ORDER BY i)",
        "viterbi_bi": _with(tokens, vit, recursive=True),
        "stream_parse": _with(tokens) + "SELECT doc_id, line, CAST(count(i) AS INTEGER) AS n_tokens, CAST(coalesce(max(chunk_id) + 1, 0) AS INTEGER) AS n_chunks FROM sent LEFT JOIN tk USING (doc_id, line) GROUP BY ALL",
        "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
        "head_func_tagsets": _with(tokens) + f"{tags(JUMAN)} UNION ALL {tags(UNIDIC)}",
        "chunk_features_juman": marked(JUMAN),
        "chunk_features_unidic": marked(UNIDIC),
        "format_layers": _with(feats, RULE) + f"SELECT * FROM (WITH {layers}) UNION ALL SELECT doc_id, line, 4 AS layer, a.text || b.text AS text FROM (WITH {tree}) a JOIN (WITH {_LATTICE.format(score="'0.000000'", of='linked')}) b USING (doc_id, line)",
        "entity_features": _with(tokens) + f"SELECT * FROM (WITH {entity})",
        "link_examples": _with(feats, _PASS, recursive=True) + f", {walk}",
        "merged_dictionary": _with(MODEL, talk) + "SELECT feature, id FROM mdic",
        "merged_vectors": _with(MODEL, talk) + """SELECT sv_id, alpha, array_to_string(x, ',') AS x FROM svx UNION ALL
          SELECT (SELECT max(sv_id) FROM svx) + 1 + doc_id * 100 + line AS sv_id, (doc_id % 7 - 3) / 32.0::DOUBLE AS alpha, array_to_string(list_sort(list(id)), ',') AS x FROM told JOIN mdic USING (feature) GROUP BY doc_id, line""",
        "flagship": _with(chunks, _PASS, _LATTICE.format(score="printf('%.6f', score::DOUBLE)", of="linked"), recursive=True),
    }
