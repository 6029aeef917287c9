"""Token-based translation of MySQL- and PostgreSQL-flavoured SQL to Spark SQL.

Strings, comments and quoted names are tokens, so nothing inside them is ever rewritten. Parentheses
nest into groups, and each rule works on a list of tokens whose groups are done already.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)"
    r"|(?P<string>'(?:[^'\\]|\\.|'')*')"
    r'|(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)'
    r"|(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    r"|(?P<param>:[A-Za-z_]\w*|\?|\$\d+)"
    r"|(?P<word>[A-Za-z_]\w*)"
    r"|(?P<op>->>|->|@>|<@|<=>|<>|!=|<=|>=|\|\||::|[-+*/%=<>!.,;&|^~\[\]{}@#])"
    r"|(?P<open>\()|(?P<close>\))",
    re.S,
)
#: MySQL's date specifiers in Spark's pattern letters (fixed values).
DATE_LETTERS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h",
    "i": "mm", "s": "ss", "S": "ss", "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss",
}
UNITS = {"SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "YEAR"}
#: Words that end an operand.
KEYWORDS = set(
    "select from where group by having order limit offset union all join left right full inner outer cross on and or not in is as"
    " between like ilike case when then else end distinct exists any set values into insert update delete with using asc desc filter over returning conflict do nothing".split()
)


class SqlError(ValueError):
    """The statement cannot be read."""


@dataclass
class Token:
    kind: str  # space, string, quoted, number, param, word, op, group, raw
    text: str
    body: list[Token] | None = None

    def __str__(self) -> str:
        return f"({render(self.body)})" if self.kind == "group" else self.text

    def is_word(self, *names: str) -> bool:
        return self.kind == "word" and self.text.lower() in names


def render(tokens: list[Token]) -> str:
    return "".join(map(str, tokens))


def tokenize(sql: str) -> list[Token]:
    """Tokens with parentheses nested into groups."""
    stack: list[list[Token]] = [[]]
    at = 0
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"cannot read {sql[at : at + 20]!r}")
        at = m.end()
        match m.lastgroup:
            case "open":
                stack.append([])
            case "close":
                if len(stack) == 1:
                    raise SqlError("a parenthesis closes that is not open")
                body = stack.pop()
                stack[-1].append(Token("group", "", body))
            case kind:
                stack[-1].append(Token(kind, " " if kind == "space" else m[0]))
    if len(stack) > 1:
        raise SqlError("a parenthesis is not closed")
    return stack[0]


def raw(text: str) -> Token:
    return Token("raw", text)


def solid(tokens: list[Token]) -> list[Token]:
    return [t for t in tokens if t.kind != "space"]


def split(tokens: list[Token], sep: str = ",") -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    for t in tokens:
        if t.kind == "op" and t.text == sep:
            out.append([])
        else:
            out[-1].append(t)
    return out


def literal(text: str) -> str:
    """The value of a quoted string token."""
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1] if m[1] in "'\"\\" else "\\" + m[1]), text[1:-1].replace("''", "'"))


def quoted(value: str) -> str:
    """A Spark string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def date_pattern(fmt: str) -> str:
    out, at = [], 0
    for m in re.finditer(r"%(.)|[A-Za-z]+|'", fmt):
        out.append(fmt[at : m.start()])
        at = m.end()
        if m[1]:
            out.append(DATE_LETTERS.get(m[1], "%" if m[1] == "%" else f"'%{m[1]}'"))
        else:
            out.append("''" if m[0] == "'" else f"'{m[0]}'")
    return "".join(out) + fmt[at:]


def computed_pattern(fmt: str) -> str:
    """``date_pattern`` of a format that is an expression itself: letters outside specifiers are quoted, then
    each specifier is replaced."""
    out = f"""regexp_replace({fmt}, '(?<![%A-Za-z])[A-Za-z]+|(?<=%[A-Za-z])[A-Za-z]+', "'$0'")"""
    for letter, spark in DATE_LETTERS.items():
        out = f"replace({out}, '%{letter}', '{spark}')"
    return f"replace({out}, '%%', '%')"


def contains(doc: str, candidate: object) -> str:
    """Containment of a literal JSON candidate, as a built-in expression over a JSON string: objects hold every
    key of the candidate's, arrays an element for each of its elements, and scalars are equal in type and value
    (numbers by value alone). A candidate that is null itself is in no document."""
    return "false" if candidate is None else f"coalesce({_within(f'try_parse_json(CAST({doc} AS STRING))', candidate, 0)}, false)"


def _within(doc: str, candidate: object, depth: int) -> str:
    kind = f"schema_of_variant({doc})"
    match candidate:
        case None:
            return f"is_variant_null({doc})"
        case bool():
            return f"({kind} = 'BOOLEAN' AND try_variant_get({doc}, '$', 'boolean') = {str(candidate).lower()})"
        case int() | float():
            return f"(({kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {kind} LIKE 'DECIMAL%') AND try_variant_get({doc}, '$', 'double') = {float(candidate)!r}D)"
        case str():
            return f"({kind} = 'STRING' AND try_variant_get({doc}, '$', 'string') = {quoted(candidate)})"
        case dict():
            under = [_within(f"try_variant_get({doc}, {quoted(key_path(k))}, 'variant')", v, depth) for k, v in candidate.items()]
            return "(" + " AND ".join([f"{kind} LIKE 'OBJECT%'", *under]) + ")"
    name = f"_e{depth}"
    each = [f"exists(try_variant_get({doc}, '$', 'array<variant>'), {name} -> coalesce({_within(name, v, depth + 1)}, false))" for v in candidate]
    return "(" + " AND ".join([f"{kind} LIKE 'ARRAY%'", *each]) + ")"


def key_path(key: str) -> str:
    """The path of an object's key; single quotes around it unless it has one."""
    return f"$['{key}']" if "'" not in key else f'$["{key}"]'


def plain_keys(candidate: object) -> bool:
    """Whether paths can name every key of a candidate."""
    if isinstance(candidate, dict):
        return all(not ({"'", '"'} <= set(k)) and "]" not in k and k for k in candidate) and all(map(plain_keys, candidate.values()))
    return all(map(plain_keys, candidate)) if isinstance(candidate, list) else True


DATES = "('date', 'timestamp', 'timestamp_ntz')"


def cast(value: str, target: str) -> str:
    """CAST with MySQL's target types and forgiving conversions. NULL stays NULL; text that is no number counts
    as 0; dates count as YYYYMMDD or as seconds. typeof() is a constant, so one branch is left of each CASE."""
    base = re.match(r"\s*(\w+)", target)[1].upper()
    text, kind = f"CAST({value} AS STRING)", f"typeof({value})"
    truth = f"WHEN {kind} = 'boolean' THEN if({text} = 'true', 1, 0)"
    match base:
        case "SIGNED" | "INT" | "INTEGER" | "BIGINT" | "SMALLINT" | "TINYINT" | "UNSIGNED":
            number = (
                f"CASE WHEN {value} IS NULL THEN NULL {truth} WHEN {kind} IN {DATES} THEN try_cast(replace(substr({text}, 1, 10), '-', '') AS BIGINT)"
                f" WHEN {kind} IN ('double', 'float') OR {kind} LIKE 'decimal%' THEN try_cast(try_cast({text} AS DOUBLE) AS BIGINT)"
                f" ELSE coalesce(try_cast(trim({text}) AS BIGINT), 0) END"
            )
            return f"(CASE WHEN ({number}) < 0 THEN 0 ELSE ({number}) END)" if base == "UNSIGNED" else f"({number})"
        case "DOUBLE" | "FLOAT" | "REAL" | "DECIMAL" | "NUMERIC":
            seconds = f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', try_cast({text} AS TIMESTAMP_NTZ))"
            return f"(CASE WHEN {value} IS NULL THEN NULL {truth} WHEN {kind} IN {DATES} THEN {seconds} ELSE coalesce(try_cast(trim({text}) AS DOUBLE), 0D) END)"
        case "CHAR" | "TEXT" | "VARCHAR" | "BINARY" | "NCHAR" | "STRING":
            return f"CAST({value} AS STRING)"
        case "DATETIME" | "TIMESTAMP":
            return f"try_cast({value} AS TIMESTAMP_NTZ)"
        case "DATE":
            return f"CAST(try_cast({value} AS DATE) AS TIMESTAMP_NTZ)"
        case "TIME":  # the clock on a fixed day
            clock = f"coalesce(try_cast(if({text} RLIKE '^ *[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})? *$', concat('2000-01-01 ', trim({text})), NULL) AS TIMESTAMP_NTZ), try_cast({text} AS TIMESTAMP_NTZ))"
            return f"try_cast(concat('2000-01-01 ', date_format({clock}, 'HH:mm:ss.SSSSSS')) AS TIMESTAMP_NTZ)"
        case "JSON" | "JSONB":
            return f"to_json(parse_json(CAST({value} AS STRING)))"
        case "BOOL" | "BOOLEAN":
            return (
                f"(CASE WHEN {value} IS NULL THEN NULL WHEN {kind} = 'boolean' THEN {text} = 'true' WHEN {kind} = 'string' THEN {text} <> ''"
                f" WHEN {kind} IN {DATES} THEN true ELSE coalesce(try_cast({text} AS DOUBLE) <> 0, true) END)"
            )
    return f"CAST({value} AS {target})"


def later(value: str, sign: str, amount: str, unit: str) -> str:
    """DATE_ADD and DATE_SUB; a day beyond the end of the month runs on into the next one."""
    start = f"CAST({value} AS TIMESTAMP_NTZ)"
    if unit == "WEEK":
        return f"({start} {sign} INTERVAL '7' DAY * ({amount}))"
    if unit not in ("MONTH", "YEAR"):
        return f"({start} {sign} INTERVAL '1' {unit} * ({amount}))"
    days = f"INTERVAL '1' DAY * (day({start}) - 1)"
    return f"((({start} - {days}) {sign} INTERVAL '1' {unit} * ({amount})) + {days})"


def month_number(x: str) -> str:
    return f"(year({x}) * 12 + month({x}))"


def function(name: str, args: list[list[Token]]) -> str | None:
    """The Spark form of a function call whose arguments are translated, or None to leave it."""
    a = [render(x).strip() for x in args]
    match name, len(a):
        case ("length" | "char_length" | "character_length"), 1:
            return f"octet_length({a[0]})"
        case ("now" | "sysdate" | "current_timestamp" | "curtime" | "current_time"), _ if not "".join(a):
            return "CAST(current_timestamp() AS TIMESTAMP_NTZ)"
        case ("curdate" | "current_date"), _ if not "".join(a):
            return "CAST(current_date() AS TIMESTAMP_NTZ)"
        case "date", 1:
            return f"CAST(try_cast({a[0]} AS DATE) AS TIMESTAMP_NTZ)"
        case ("datetime" | "timestamp"), 1:
            return f"try_cast({a[0]} AS TIMESTAMP_NTZ)"
        case "dayofmonth", 1:
            return f"day({a[0]})"
        case "timestampdiff", 3:
            unit = a[0].strip("'\"`").upper()
            if unit in ("MONTH", "YEAR"):
                f = month_number if unit == "MONTH" else (lambda x: f"year({x})")
                return f"({f(a[2])} - {f(a[1])})"
            return f"timestampdiff({unit}, {a[1]}, {a[2]})"
        case "date_format", 2 if args[1] and (s := solid(args[1])) and s[0].kind == "string":
            return f"date_format({a[0]}, {quoted(date_pattern(literal(s[0].text)))})"
        case "date_format", 2:
            return f"date_format({a[0]}, {computed_pattern(a[1])})"
        case ("date_add" | "adddate" | "date_sub" | "subdate"), 2 if (s := solid(args[1])) and s[0].is_word("interval"):
            sign = "+" if name in ("date_add", "adddate") else "-"
            amount, unit = render(s[1:-1]).strip().strip("'"), s[-1].text.upper()
            if unit not in UNITS:
                raise SqlError(f"unknown interval unit {unit}")
            return later(a[0], sign, amount, unit)
        case "json_extract", 2:
            return f"get_json_object({a[0]}, {a[1]})"
        case "json_unquote", 1:
            text = f"CAST({a[0]} AS STRING)"
            return f"""coalesce(if({text} LIKE '"%"', try_variant_get(try_parse_json({text}), '$', 'string'), NULL), {text})"""
        case "json_parse", 1:
            return f"to_json(parse_json({a[0]}))"
        case "json_keys", 1:
            return f"to_json(array_sort(json_object_keys({a[0]})))"
        case "json_type", 1:
            return f"(CASE WHEN {a[0]} IS NULL THEN NULL WHEN try_parse_json(CAST({a[0]} AS STRING)) IS NULL THEN 'STRING' WHEN schema_of_variant(try_parse_json(CAST({a[0]} AS STRING))) LIKE 'OBJECT%' THEN 'OBJECT' WHEN schema_of_variant(try_parse_json(CAST({a[0]} AS STRING))) LIKE 'ARRAY%' THEN 'ARRAY' ELSE 'SCALAR' END)"
        case "json_contains", 2:
            return json_contains(a[0], args[1])
        case "round", 1:
            return f"CAST(round({a[0]}) AS BIGINT)"
        case "round", 2:
            return f"(round({a[0]} * pow(10, {a[1]})) / pow(10, {a[1]}))"
        case ("floor" | "ceil" | "ceiling"), 1:
            return f"CAST({name}({a[0]}) AS BIGINT)"
        case "convert", 2:
            return cast(a[0], a[1])
        case ("cast" | "convert"), 1 if not any(t.is_word("as", "using") for t in args[0]):  # a plain function of one argument
            return f"({a[0]})"
        case "convert", 1 if (i := next((i for i, t in enumerate(args[0]) if t.is_word("using")), None)) is not None:
            return f"CAST({render(args[0][:i]).strip()} AS STRING)"
        case "cast", 1 if (i := next((i for i, t in reversed(list(enumerate(args[0]))) if t.is_word("as")), None)) is not None:
            return cast(render(args[0][:i]).strip(), render(args[0][i + 1 :]).strip())
        case "array_agg", 1:
            return f"if(count({a[0]}) > 0, collect_list({a[0]}), NULL)"
    return None


def json_contains(doc: str, candidate: list[Token]) -> str:
    s = solid(candidate)
    if len(s) == 1 and s[0].kind == "string":
        try:
            value = json.loads(literal(s[0].text))
        except ValueError:
            return "false"
        if plain_keys(value):
            return contains(doc, value)
    return f"skerry_json_contains({doc}, {render(candidate).strip()})"


def operand_before(out: list[Token]) -> int:
    """Where the operand at the end of ``out`` begins."""
    i = len(out)
    while i and out[i - 1].kind == "space":
        i -= 1
    if i and out[i - 1].kind == "group" and i > 1 and out[i - 2].kind == "word" and out[i - 2].text.lower() not in KEYWORDS:
        i -= 1
    i -= 1
    while i > 1 and out[i - 1].kind == "op" and out[i - 1].text == ".":
        i -= 2
    return max(i, 0)


def factor(t: Token) -> bool:
    return t.kind == "op" and t.text in ("*", "/", "%") or t.is_word("div")


def term_before(out: list[Token]) -> int:
    """Where the product at the end of ``out`` begins: operands with * / % DIV between them."""
    at = operand_before(out)
    while True:
        i = at
        while i and out[i - 1].kind == "space":
            i -= 1
        if not i or not factor(out[i - 1]):
            return at
        at = operand_before(out[: i - 1])


def textual(tokens: list[Token]) -> bool:
    """Whether an operand is text by its form: a string, or a function that gives text."""
    s = solid(tokens)
    if not s:
        return False
    if s[0].kind in ("string", "raw"):
        return s[0].kind == "string" or s[0].text.startswith(("concat(", "upper(", "lower("))
    return s[0].is_word("concat", "upper", "lower", "substring", "trim", "replace") and len(s) == 2 and s[1].kind == "group"


def term_after(tokens: list[Token], i: int) -> int:
    """Where the product that begins at ``i`` ends."""
    end = operand_after(tokens, i)
    while True:
        k = end
        while k < len(tokens) and tokens[k].kind == "space":
            k += 1
        if k >= len(tokens) or not factor(tokens[k]):
            return end
        end = operand_after(tokens, k + 1)


def operand_after(tokens: list[Token], i: int) -> int:
    """Where the operand that begins at ``i`` ends."""
    while i < len(tokens) and (tokens[i].kind == "space" or tokens[i].text in ("-", "+")):
        i += 1
    if i < len(tokens) and tokens[i].is_word("case"):
        depth = 0
        while i < len(tokens):
            depth += tokens[i].is_word("case") - tokens[i].is_word("end")
            i += 1
            if not depth:
                return i
    named = i < len(tokens) and tokens[i].kind in ("word", "quoted")
    i += 1
    while i + 1 < len(tokens) and tokens[i].kind == "op" and tokens[i].text == ".":
        i += 2
    if named and i < len(tokens) and tokens[i].kind == "group":
        i += 1
    return i


def translated(tokens: list[Token]) -> list[Token]:
    """One level of tokens, groups first."""
    for t in tokens:
        if t.kind == "group":
            t.body = translated(t.body)
    out: list[Token] = []
    i = 0

    def following(k: int) -> int:
        while k < len(tokens) and tokens[k].kind == "space":
            k += 1
        return k

    while i < len(tokens):
        t = tokens[i]
        n = following(i + 1)
        after = tokens[n] if n < len(tokens) else None
        if t.kind == "quoted" and t.text[0] == '"':
            out.append(raw("`" + t.text[1:-1].replace('""', '"').replace("`", "``") + "`"))
        elif t.kind == "string":
            out.append(raw(quoted(literal(t.text))))
            out[-1].kind, out[-1].text = "string", quoted(literal(t.text))
        elif t.kind == "param" and t.text[0] == "$":
            out.append(raw(f":p{t.text[1:]}"))
        elif t.is_word("straight_join"):
            out.append(raw("FULL OUTER JOIN"))
        elif t.is_word("from") and after and after.is_word("dual"):
            i = n
        elif t.is_word("escape") and after and after.kind == "string" and literal(after.text) == "":
            i = n
        elif t.is_word("limit") and (parts := limit_pair(tokens, i)):
            first, second, end = parts
            out += [raw(f"LIMIT {second} OFFSET {first}")]
            i = end
        elif t.kind == "op" and t.text in ("=", "<>", "!=") and after and after.is_word("any", "all", "some"):
            g = following(n + 1)
            if g < len(tokens) and tokens[g].kind == "group":
                if (t.text == "=") == after.is_word("all"):
                    raise SqlError(f"{t.text} {after.text} is not supported")
                out += [raw(" IN " if t.text == "=" else " NOT IN "), tokens[g]]
                i = g
            else:
                out.append(t)
        elif t.kind == "op" and t.text in ("->", "->>", "@>", "<@"):
            start = operand_before(out)
            left = render(out[start:]).strip()
            end = operand_after(tokens, i + 1)
            right = translated(tokens[i + 1 : end])
            del out[start:]
            if t.text in ("->", "->>"):
                path = literal(solid(right)[0].text) if solid(right)[0].kind == "string" else None
                key = quoted(path if path and path.startswith("$") else f"$.{path}") if path is not None else render(right).strip()
                out.append(raw(f"get_json_object({left}, {key})"))
            elif t.text == "@>":
                out.append(raw(json_contains(left, right)))
            else:
                s = tokenize(left) if left.startswith("'") else [raw(left)]
                out.append(raw(json_contains(render(right).strip(), s)))
            i = end - 1
        elif t.kind == "op" and t.text == "/" or t.is_word("div"):
            end = operand_after(tokens, i + 1)
            right = render(translated(tokens[i + 1 : end])).strip()
            out += [t, raw(f" nullif({right}, 0)")]
            i = end - 1
        elif t.kind == "op" and t.text == "%":  # of whole operands, the left one with all factors before it
            start, end = term_before(out), operand_after(tokens, i + 1)
            left, right = render(out[start:]).strip(), render(translated(tokens[i + 1 : end])).strip()
            del out[start:]
            out.append(raw(f"(CAST({left} AS BIGINT) % nullif(CAST({right} AS BIGINT), 0))"))
            i = end - 1
        elif t.kind == "op" and t.text == "+" and solid(out) and (textual(out[(start := term_before(out)) :]) or textual(tokens[i + 1 : term_after(tokens, i + 1)])):
            end = term_after(tokens, i + 1)
            left, right = render(out[start:]).strip(), render(translated(tokens[i + 1 : end])).strip()
            del out[start:]
            out.append(raw(f"concat(CAST({left} AS STRING), CAST({right} AS STRING))"))
            i = end - 1
        elif t.kind == "number" and t.text[:2].lower() == "0x":
            out.append(raw(str(int(t.text, 16))))
        elif t.is_word("b", "x") and i + 1 < len(tokens) and tokens[i + 1].kind == "string" and re.fullmatch("[01]+" if t.text.lower() == "b" else "[0-9a-fA-F]+", tokens[i + 1].text[1:-1]):
            out.append(raw(str(int(tokens[i + 1].text[1:-1], 2 if t.text.lower() == "b" else 16))))
            i += 1
        elif t.kind == "op" and t.text == "::":
            start = operand_before(out)
            end = operand_after(tokens, i + 1)
            value = render(out[start:]).strip()
            del out[start:]
            out.append(raw(cast(value, render(tokens[i + 1 : end]).strip())))
            i = end - 1
        elif t.kind == "word" and n == i + 1 and after and after.kind == "group" and t.text.lower() not in KEYWORDS:
            behind = following(n + 1)
            extended = behind < len(tokens) and tokens[behind].is_word("over", "filter")
            new = None if extended and t.text.lower() == "array_agg" else function(t.text.lower(), split(after.body))
            if new is None:
                out += [t, after]
            else:
                out.append(raw(new))
            i = n
        elif t.is_word("current_timestamp", "current_time", "current_date") and not (after and after.kind == "group"):
            out.append(raw(function(t.text.lower(), [[]])))
        else:
            out.append(t)
        i += 1
    return out


def limit_pair(tokens: list[Token], i: int) -> tuple[str, str, int] | None:
    j, found = i + 1, []
    while j < len(tokens) and len(found) < 3:
        if tokens[j].kind != "space":
            found.append((j, tokens[j]))
        j += 1
    if len(found) == 3 and found[1][1].text == "," and found[0][1].kind in ("number", "param") and found[2][1].kind in ("number", "param"):
        return found[0][1].text, found[2][1].text, found[2][0]
    return None


def to_spark(sql: str) -> str:
    """A query of the accepted dialects in Spark SQL."""
    return render(translated(tokenize(sql.strip().rstrip(";")))).strip()
