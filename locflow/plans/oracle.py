"""DuckDB SQL pieces of the twins, stated from the specification.

The oracle is an independent statement of each query: the registered Spark
job and its SQL twin must agree on row count, schema and values. Nothing of
the engine is imported here; patterns, rule order, vocabularies and templates
are written down once more, in RE2 and SQL terms.
"""

from __future__ import annotations

_VERBATIM = r'(?:\$@|@\$?)"[^"]*(?:""[^"]*)*"'
_REGULAR = r'\$?"[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"'
_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\\\n]*)'"
_HOLE = r"\{[^\"'{}\n]*(?:(?:\"[^\"\\\n]*(?:\\[^\n][^\"\\\n]*)*\"|" + _CHAR + r")[^\"'{}\n]*)*\}"
_HOLED = r'\$"[^"\\{\n]*(?:(?:\\[^\n]|\{\{|' + _HOLE + r')[^"\\{\n]*)*"'
_COMMENTS = r"//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
TOKENS = {"code": f"{_VERBATIM}|{_HOLED}|{_REGULAR}|{_COMMENTS}|{_CHAR}" + r"|(?m:^)[ \t]*#[^\n]*", "markup": r'"[^"]*"'}
LITERAL_KINDS = "('regular', 'verbatim', 'interpolated')"
NL = "chr(10)"
WS = r"[\p{Z}\t\n\x0B\f\r\x{85}]"
EDGES = (r"^[^\p{L}\p{N}]{0,2}", r"[^\p{L}\p{N}]{0,2}\z")
BOLD = r"(?s)^" + WS + r"*(<b>)(.*)(</b>)" + WS + r"*\z"
CONST_LINE = r'const string\s+(\w+)\s*=[^"]*"(.*)"'
LOOKUP = ("sess.i18n(XlfKeys.", ")")
WRAPPERS = ("RLData.en[", "RLData.cs[")
STOP = {
    "tag": "a abbr b body br button div em footer form h1 h2 h3 head header html i img input label li link meta nav ol "
           "option p script section select small span strong style table tbody td textarea th thead title tr u ul",
    "attr": "alt charset class content href id lang name rel src style target title type value width height",
    "value": "utf-8 text/css text/javascript stylesheet button submit hidden _blank",
    "ext": ".aspx .cs .css .gif .htm .html .jpg .js .json .png .svg .txt .xlf .xml",
}


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def ws_trim(e: str) -> str:
    blanks = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
    return f"trim({e}, {' || '.join(f'chr({c})' for c in blanks)})"


def blank(e: str) -> str:
    return f"({e} IS NULL OR NOT regexp_matches({e}, {q('[^' + WS[1:])}))"


def newlines(e: str) -> str:
    return f"(length({e}) - length(replace({e}, {NL}, '')))"


def first_line(e: str) -> str:
    return f"split_part({e}, {NL}, 1)"


def pascal(e: str) -> str:
    k = (f"array_to_string(list_transform(regexp_extract_all(replace({e}, 'ß', 'ss'), "
         f"{q('[\\p{L}\\p{N}]+')}), lambda w: upper(w[1]) || lower(w[2:])), '')")
    return f"(CASE WHEN regexp_matches({k}, {q('^\\p{N}')}) THEN '_' || {k} ELSE {k} END)"


def carry_capital(src: str, tgt: str) -> str:
    return f"(CASE WHEN regexp_matches({src}, {q('^\\p{Lu}')}) THEN upper({tgt}[1]) || {tgt}[2:] ELSE {tgt} END)"


def lookup(key: str) -> str:
    return f"({q(LOOKUP[0])} || {key} || {q(LOOKUP[1])})"


def const_decl(key: str) -> str:
    return f"('public const string ' || {key} || ' = \"' || {key} || '\";')"


def doc_lines_cte() -> str:
    return ("doc_lines AS (SELECT doc_id, lang, "
            "CAST(generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS BIGINT) AS line_no, "
            "unnest(string_split_regex(text, '\\r?\\n')) AS line FROM documents), "
            f"doc_texts AS (SELECT doc_id, lang, line_no, line AS text FROM doc_lines WHERE NOT {blank('line')})")


def code_cte() -> str:
    consts = ("array_to_string(list_transform(string_split_regex(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), '\\r?\\n'), "
              "lambda l, i: '    public const string K' || doc_id || '_' || i || ' = \"' || l || '\";'), chr(10))")
    tail = [
        "'var u = \"http://x/' || doc_id || '\" + \"y' || doc_id || '\"; // tail \"c\"'",
        "'var e = \"a\\\"b' || doc_id || '\";'",
        "'var v = @\"c:\\d' || doc_id || '\\\";'",
        "'var w = \"<b>Item ' || doc_id || '</b>\";'",
        "'var r = RLData.en[\"K' || doc_id || '_1\"];'",
        "'var m = @\"First ' || doc_id || chr(10) || 'second \"\"line\"\" of ' || doc_id || '\";'",
        "'var f = $\"Hello {name} ' || doc_id || '\";'",
        "'var g = $@\"Dir {name}\\' || doc_id || '\";'",
        """'var i = $"Is {(ok ? "yes ' || doc_id || '" : "no")} or {m["k\\""]:N1}, {(c == ''"'' ? 1 : 2)} {{' || doc_id || '}}" """
        """+ "then ' || doc_id || '";'""",
        "'var s = \"Tab\\there\\n\\u00e9\\x41\\U0001F600\\uD83D\\uDE00 \\\\ done\\0 ' || doc_id || ' \\q\\uD800\";'",
        "'var b = \"\\\\\\\\\" + @\"\\\\\" + \"\\\\x\";'",
        "'var n = \"' || doc_id || '.5\" + \"user_name' || doc_id || '\" + \"*** --- ***\" + \"./up/' || doc_id || '\";'",
        "'var h = \"href\" + \"table\" + \".css\" + \"hidden\" + \"report' || doc_id || '.xml\" + \"f' || doc_id || '.cs\";'",
        "'var k = \"Saved.ok\" + \"Say \\\"hi\\\"\" + \"Label ' || doc_id || ':\";'",
        """'char q = ''"''; var d = "after ' || doc_id || '"; char e = ''"'', f2 = ''\\'''', g2 = ''\\\\'', h2 = ''\\u0022'';'""",
        """'/* block "quoted ' || doc_id || '"' || chr(10) || ' it''s "two" // lines **/ var p = "behind ' || doc_id || '"; // it''s "one"'""",
        """'#region don''t "touch" ' || doc_id""",
        """'var t = a/"slash ' || doc_id || '"*2; /**/ var o = "/* no comment ' || doc_id || ' */"; /***"x"***/'""",
        """'  # endregion "'""",
        """'[Obsolete("Use other ' || doc_id || '")]'""",
        """'if (x.StartsWith("Pick ' || doc_id || '") || m["Item ' || doc_id || '"] == "Done ' || doc_id || '" && "Yes ' || doc_id """
        """|| '" != y) Show("Pick ' || doc_id || '", /* and */ "Done ' || doc_id || '");'""",
        """'switch (x) { case "Case ' || doc_id || '": Add(key, "Case ' || doc_id || '" + "tail ' || doc_id || '"); break; }'""",
        """'w = w.Replace(''a'', "Repl ' || doc_id || '").Replace("old ' || doc_id || '", "new ' || doc_id || '" + n);'""",
    ]
    return ("code AS (SELECT doc_id, lang, 'src/' || source || '/f' || doc_id || '.cs' AS path, "
            "concat_ws(chr(10), 'namespace N {', '// \"note ' || doc_id || '\"', " + consts + ", "
            + ", ".join(tail) + ", CASE WHEN regexp_matches(text, '[0-9]') THEN 'var z = \"open' END, '}') "
            "AS content FROM documents), "
            "code_lines AS (SELECT doc_id, "
            "CAST(generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) AS BIGINT) AS line_no, "
            "unnest(string_split_regex(content, '\\r?\\n')) AS line FROM code)")


def pages_cte() -> str:
    return ("pg AS (SELECT page_id, url, html, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS page_lang "
            "FROM pages)")


def stray(text: str, profile: str = "code") -> str:
    """Openers outside all tokens of a text."""
    g = f"array_to_string(string_split_regex({text}, {q(TOKENS[profile])}), chr(10))"
    n = lambda o: f"(length({g}) - length(replace({g}, {q(o)}, ''))) // {len(o)}"
    return "(" + " + ".join(map(n, ('"', "'", "/*") if profile == "code" else ('"',))) + ")"


def context(profile: str) -> str:
    """Place of a token by the gap before (``gap``) and behind it (``nxt``); null where the token before it decides."""
    m = lambda e, p: f"regexp_matches({e}, {q(p)})"
    call = r"^\s*(?:,[^(){};]*)?\(\s*([A-Za-z0-9_]+)"
    if profile == "markup":
        name = f"lower(reverse(regexp_extract(reverse(gap), {q(r'^\s*=\s*([A-Za-z0-9:_.-]+)')}, 1)))"
        return f"CASE WHEN {name} <> '' THEN 'attr:' || {name} ELSE '' END"
    return (f"CASE WHEN {m('reverse(gap)', r'^\s*=[=!]')} OR {m('nxt', r'^\s*[=!]=')} THEN 'compare' "
            f"WHEN {m('gap', r'^\s*[,+]?\s*$')} THEN NULL "
            f"WHEN {m('reverse(gap)', r'^\s*(?:,[^(){};]*)?\(\s*[A-Za-z0-9_.:]+\s*\[(?:[ \t\r]*(?:\n|\z)|\s*[{};])')} THEN 'attribute' "
            f"WHEN {m('reverse(gap)', r'^\s+esac(?:[^A-Za-z0-9_]|\z)')} THEN 'case' "
            f"WHEN {m('reverse(gap)', r'^\s*\[\s*[A-Za-z0-9_\])]')} THEN 'index' "
            f"WHEN {m('reverse(gap)', call)} THEN 'call:' || reverse(regexp_extract(reverse(gap), {q(call)}, 1)) ELSE '' END")


CALLS = ("Attribute Combine Compare CompareTo Contains Element EndsWith Equals FindName GetAttribute GetEnvironmentVariable GetField "
         "GetMethod GetProperty IndexOf LastIndexOf OpenSubKey Replace SetAttribute Split StartsWith Trim TrimEnd TrimStart")
SHOWN = "alt aria-label content label placeholder summary title value"


def place_rules(c: str = "context") -> str:
    """The rules of a place, for the front of ``reason``."""
    some = lambda words: "(" + ", ".join(map(q, words.split())) + ")"
    return (f"WHEN {c} IN ('attribute', 'case', 'index', 'compare') THEN 'context:' || {c} "
            f"WHEN starts_with({c}, 'call:') AND {c}[6:] IN {some(CALLS)} THEN 'context:call' "
            f"WHEN starts_with({c}, 'attr:') AND {c}[6:] NOT IN {some(SHOWN)} THEN 'context:attr'")


def literals_cte(name: str, src: str, ids: list[str], text: str, profile: str, positions: bool = True) -> str:
    """Tokens of ``src.text`` with ordinal, kind, text, wrapped, context[, offset, line_no]."""
    pat = q(TOKENS[profile])
    idl = ", ".join(ids)
    wrapped = " OR ".join(f"ends_with(gap, {q(p)})" for p in WRAPPERS)
    pos = ""
    win = f" WINDOW u AS (PARTITION BY {idl} ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    if positions:
        pos = (f", CAST(coalesce(sum(length(gap) + length(raw)) OVER w, 0) + length(gap) AS BIGINT) AS \"offset\""
               f", CAST(coalesce(sum({newlines('gap')} + {newlines('raw')}) OVER w, 0) + {newlines('gap')} + 1 AS BIGINT) AS line_no")
        win += f", w AS (PARTITION BY {idl} ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    first = "strpos(raw, '\"')"
    return (f"{name}_t AS (SELECT {idl}, regexp_extract_all({text}, {pat}) AS toks, "
            f"string_split_regex({text}, {pat}) AS gaps FROM {src}), "
            f"{name}_x AS (SELECT {idl}, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS ordinal, "
            f"unnest(toks) AS raw, unnest(gaps[1:len(toks)]) AS gap, unnest(gaps[2:]) AS nxt FROM {name}_t), "
            f"{name}_k AS (SELECT *, CASE WHEN starts_with(raw, '//') THEN 'comment' WHEN starts_with(raw, '/*') THEN 'block' "
            f"WHEN starts_with(raw, chr(39)) THEN 'char' WHEN regexp_matches(raw, '^[ \\t]*#') THEN 'directive' "
            f"WHEN contains(split_part(raw, '\"', 1), '$') THEN 'interpolated' "
            f"WHEN starts_with(raw, '@') THEN 'verbatim' ELSE 'regular' END AS kind, {context(profile)} AS own FROM {name}_x), "
            f"{name}_a AS (SELECT {idl}, ordinal, kind, raw, "
            f"substr(raw, {first} + 1, length(raw) - {first} - 1) AS text, "
            f"({wrapped}) AS wrapped, coalesce(last_value(own IGNORE NULLS) OVER u, '') AS context{pos} FROM {name}_k{win}), "
            f"{name} AS (SELECT * FROM {name}_a WHERE kind IN {LITERAL_KINDS})")


def stop_cte() -> str:
    values = ", ".join(f"({q(k)}, {q(t)})" for k, tokens in STOP.items() for t in tokens.split())
    return f"stop AS (SELECT token, min(kind) AS stop_kind FROM (VALUES {values}) v(kind, token) GROUP BY token)"


def reason(text: str, first: str = "") -> str:
    """Rules in order; expects ``stop_kind`` from a left join to ``stop``. ``first``: user rules behind blank."""
    exts = "[" + ", ".join(map(q, STOP["ext"].split())) + "]"
    m = lambda p, e=text: f"regexp_matches({e}, {q(p)})"
    name = (f"({m(r'^[A-Za-z0-9_.-]+$')} AND NOT starts_with({text}, '.') AND NOT contains({text}, '..') "
            f"AND list_contains({exts}, regexp_extract({text}, '[.][^.]*$')))")
    drive = m(r"^(/|\./|\.\./|~/|[A-Za-z]:[\\/]|\\\\[A-Za-z0-9])")
    parts = f"({m(r'[A-Za-z0-9_.-]\\[A-Za-z0-9_.-]')} AND NOT {m(chr(92).join(['[', 't', 'n', 'x0B', 'f', 'r ]']))})"
    identifier = m(r"_|[a-z][A-Z]|[A-Za-z][0-9]", f"substr({text}, 2)")
    return ("(CASE " + f"WHEN {blank(text)} THEN 'blank' " + first + " WHEN stop_kind IS NOT NULL THEN 'stop:' || stop_kind "
            f"WHEN {m(r'^[A-Za-z][A-Za-z0-9+.-]*://')} THEN 'url' "
            f"WHEN {drive} OR {parts} OR {name} THEN 'path' "
            f"WHEN {m('[0-9]')} AND NOT {m(r'\p{L}')} THEN 'number' "
            f"WHEN {m(r'^[A-Za-z_][A-Za-z0-9_]*$')} AND {identifier} THEN 'identifier' "
            f"WHEN NOT {m(r'\p{L}')} THEN 'no_letter' ELSE 'text' END)")


def edges(text: str) -> tuple[str, str, str]:
    prefix = f"regexp_extract({text}, {q(EDGES[0])}, 0)"
    rest = f"substr({text}, length({prefix}) + 1)"
    suffix = f"regexp_extract({rest}, {q(EDGES[1])}, 0)"
    core = f"substr({rest}, 1, length({rest}) - length({suffix}))"
    return prefix, core, suffix


def split_cte(name: str, src: str) -> str:
    """``src`` with prefix, core and suffix of its text: bold tags, then edge characters, unless the core is blank."""
    hit = bold_hit("text")
    return (f"{name}_1 AS (SELECT *, CASE WHEN {hit} THEN substr(text, 1, strpos(text, '<b>') + 2) ELSE '' END AS b0, "
            f"CASE WHEN {hit} THEN {bold('text', 2)} ELSE text END AS bc FROM {src}), "
            f"{name}_2 AS (SELECT *, substr(text, length(b0) + length(bc) + 1) AS b1, regexp_extract(bc, {q(EDGES[0])}, 0) AS e0 FROM {name}_1), "
            f"{name}_3 AS (SELECT *, substr(bc, length(e0) + 1) AS er FROM {name}_2), "
            f"{name}_4 AS (SELECT *, regexp_extract(er, {q(EDGES[1])}, 0) AS e1 FROM {name}_3), "
            f"{name}_5 AS (SELECT *, substr(er, 1, length(er) - length(e1)) AS ec FROM {name}_4), "
            f"{name} AS (SELECT * EXCLUDE (b0, bc, b1, e0, er, e1, ec), "
            f"CASE WHEN {blank('ec')} THEN '' ELSE b0 || e0 END AS prefix, CASE WHEN {blank('ec')} THEN text ELSE ec END AS core, "
            f"CASE WHEN {blank('ec')} THEN '' ELSE e1 || b1 END AS suffix FROM {name}_5)")


def split_lookup() -> str:
    """Lookup of ``key`` between ``prefix`` and ``suffix`` written as literals; null without a key."""
    one = lambda e: f"'\"' || {escape(e)} || '\"'"
    return (f"(CASE WHEN key IS NULL THEN NULL WHEN prefix = '' AND suffix = '' THEN {lookup('key')} ELSE '(' || "
            f"CASE WHEN prefix = '' THEN '' ELSE {one('prefix')} || ' + ' END || {lookup('key')} || "
            f"CASE WHEN suffix = '' THEN '' ELSE ' + ' || {one('suffix')} END || ')' END)")


def bold(text: str, i: int) -> str:
    return f"regexp_extract({text}, {q(BOLD)}, {i})"


def bold_hit(text: str) -> str:
    return f"regexp_matches({text}, {q(BOLD)})"


def const_key(line: str) -> str:
    return f"regexp_extract({line}, {q(CONST_LINE)}, 1)"


def const_value(line: str) -> str:
    return f"regexp_extract({line}, {q(CONST_LINE)}, 2)"


def const_hit(line: str) -> str:
    return f"regexp_matches({line}, {q(CONST_LINE)})"


def profiles_cte(src: str, lang: str, text: str, n: int = 50) -> str:
    return (f"prof_counts AS (SELECT lang, token, count(*) AS n FROM (SELECT {lang} AS lang, "
            f"unnest(regexp_extract_all(lower({text}), '(\\p{{L}}+)', 1)) AS token FROM {src}) GROUP BY lang, token), "
            f"profiles AS (SELECT lang, token FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS r "
            f"FROM prof_counts) WHERE r <= {n})")


def detect_cte(name: str, src: str, ids: list[str], text: str) -> str:
    idl = ", ".join(ids)
    return (f"{name}_h AS (SELECT {idl}, p.lang, count(*) AS hits FROM (SELECT {idl}, "
            f"unnest(regexp_extract_all(lower({text}), '(\\p{{L}}+)', 1)) AS token FROM {src}) t "
            f"JOIN profiles p USING (token) GROUP BY {idl}, p.lang), "
            f"{name}_b AS (SELECT {idl}, lang AS detected, hits FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY {idl} ORDER BY hits DESC, lang) AS r FROM {name}_h) WHERE r = 1), "
            f"{name} AS (SELECT {', '.join('s.' + i for i in ids)}, coalesce(b.detected, 'und') AS detected, "
            f"CAST(coalesce(b.hits, 0) AS BIGINT) AS hits FROM {src} s LEFT JOIN {name}_b b USING ({idl}))")


_HEX4 = r"(?:[0-9A-CEFa-cef][0-9A-Fa-f]{3}|[Dd][0-7][0-9A-Fa-f]{2})"
_PIECES = (r"(?s)\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|\\u" + _HEX4
           + r"|\\U00(?:0[1-9A-Fa-f]|10)[0-9A-Fa-f]{4}|\\U0000" + _HEX4 + r"|\\x(?:" + _HEX4 + r"|[0-9A-Fa-f]{1,3})|\\.|[^\\]+|\\")
_LETTERS = {"\\": 92, '"': 34, "'": 39, "n": 10, "r": 13, "t": 9, "0": 0, "a": 7, "b": 8, "f": 12, "v": 11}


def unescape(e: str) -> str:
    num = lambda x: f"('0x' || {x})::INT"
    letters = " ".join(f"WHEN p = {q(chr(92) + k)} THEN chr({v})" for k, v in _LETTERS.items())
    pair = f"chr(65536 + ({num('p[3:6]')} - 55296) * 1024 + {num('p[9:12]')} - 56320)"
    one = (f"CASE WHEN NOT starts_with(p, '\\') THEN p {letters} WHEN length(p) = 12 THEN {pair} "
           f"WHEN regexp_matches(p, {q(r'^\\[uxU][0-9A-Fa-f]')}) THEN chr({num('p[3:]')}) ELSE p END")
    return f"array_to_string(list_transform(regexp_extract_all({e}, {q(_PIECES)}), lambda p: {one}), '')"


def escape(e: str) -> str:
    for k, v in _LETTERS.items():
        if k != "'":
            e = f"replace({e}, chr({v}), {q(chr(92) + k)})"
    return e


def literal_value(kind: str, text: str) -> str:
    return (f"(CASE WHEN {kind} = 'verbatim' THEN replace({text}, '\"\"', '\"') "
            f"WHEN {kind} = 'regular' THEN {unescape(text)} ELSE {text} END)")
