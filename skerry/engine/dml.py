"""INSERT, UPSERT, UPDATE and DELETE as copy-on-write of DataFrames."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.normalize import SqlError, Token, render, solid, split, tokenize, translated
from ..storage import stored
from .schema import TYPES, Kind, SchemaError, Table, evolve, kind_of_type, kind_of_value


def name_of(t: Token) -> str:
    return t.text[1:-1].lower() if t.kind == "quoted" else t.text.lower()


def first_word(sql: str) -> str:
    """The statement's verb; of a WITH statement the one behind the common tables."""
    tokens = solid(tokenize(sql))
    if not tokens:
        return ""
    if not tokens[0].is_word("with"):
        return tokens[0].text.lower() if tokens[0].kind == "word" else "select"
    return next((t.text.lower() for t in tokens if t.is_word("select", "insert", "update", "delete")), "")


def find(tokens: list[Token], *words: str, start: int = 0) -> int:
    """Where these words follow each other, or -1."""
    for i in range(start, len(tokens)):
        at = [k for k in range(i, len(tokens)) if tokens[k].kind != "space"][: len(words)]
        if at and at[0] == i and len(at) == len(words) and all(tokens[k].is_word(w) for k, w in zip(at, words, strict=True)):
            return i
    return -1


def behind(tokens: list[Token], i: int, n: int) -> int:
    """The place behind ``n`` solid tokens from ``i`` on."""
    while n:
        n -= tokens[i].kind != "space"
        i += 1
    return i


#: Written tables that a snapshot may be the union of.
PARTS = 16


@dataclass
class Conflict:
    columns: list[str]
    sets: list[tuple[str, list[Token]]] = field(default_factory=list)
    where: list[Token] | None = None
    nothing: bool = False


def returning_of(tokens: list[Token]) -> tuple[list[Token], list[Token] | None]:
    i = find(tokens, "returning")
    return (tokens, None) if i < 0 else (tokens[:i], tokens[i + 1 :])


def returned(df: DataFrame, items: list[Token]) -> DataFrame:
    """The columns of a RETURNING clause, rows in the order of _at."""
    chosen = []
    for item in split(items):
        s = solid(item)
        if len(s) == 1 and s[0].text == "*":
            chosen += [F.col(c) for c in df.columns if c != "_at"]
        elif len(s) in (1, 2, 3) and s[0].kind in ("word", "quoted") and (len(s) < 3 or s[1].is_word("as")):
            chosen.append(F.col(name_of(s[0])).alias(name_of(s[-1])))
        else:
            raise SqlError("RETURNING takes columns")
    return df.orderBy("_at").select(*chosen)


def struct(kinds: dict[str, Kind]) -> T.StructType:
    return T.StructType([T.StructField("_rid", T.LongType()), *(T.StructField(c, TYPES[k]) for c, k in kinds.items())])


def numbered(df: DataFrame, start: int, order: str | None = None) -> DataFrame:
    """Adds _rid: by ``order`` where it is given (small inputs), else unique without a shuffle."""
    if order:
        return df.withColumn("_rid", F.row_number().over(Window.orderBy(order)).cast("long") + F.lit(start - 1))
    return df.withColumn("_rid", F.monotonically_increasing_id() + F.lit(start))


def reshaped(db, table: Table, kinds: dict[str, Kind], wipe: bool = False) -> Table:
    """``table`` with columns of ``kinds``: new ones NULL, widened ones cast."""
    if table.df is None or wipe:
        df = db.spark.createDataFrame([], struct(kinds))
        return table.but(df=df, kinds=kinds, next_rid=0, parts=())
    df, start = table.df, table.next_rid
    if start is None:  # an attached table gets row numbers with its first write
        df = stored(numbered(df, 0), "numbered")
        start = 1 << 60  # beyond all numbers that rows get without a shuffle
    columns = [F.col(c).cast(TYPES[k]).alias(c) if c in table.kinds else F.lit(None).cast(TYPES[k]).alias(c) for c, k in kinds.items()]
    same = kinds == table.kinds and df is table.df
    return table.but(df=df.select("_rid", *columns), kinds=kinds, next_rid=start, parts=table.parts if same else ())


def check_enums(name: str, table: Table, df: DataFrame) -> None:
    for column, values in table.enums.items():
        if column in df.columns:
            bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(values)).select(column).limit(1).collect()
            if bad:
                raise SchemaError(f"{name}.{column}: {bad[0][0]!r} is not one of {values}")


def is_json(tokens: list[Token]) -> bool:
    s = solid(tokens)
    if not s:
        return False
    if s[0].is_word("json_parse", "parse_json", "json_array", "json_object"):
        return True
    return s[0].is_word("cast") and len(s) == 2 and s[1].kind == "group" and solid(s[1].body)[-1].is_word("json", "jsonb")


def run(db, sql: str, args: dict, force_wipe: bool) -> DataFrame | None:
    tokens = tokenize(sql.strip().rstrip(";"))
    prefix: list[Token] = []
    if solid(tokens)[0].is_word("with"):
        at = next(i for i, t in enumerate(tokens) if t.is_word("insert", "update", "delete"))
        prefix, tokens = translated(tokens[:at]), tokens[at:]
    tokens, items = returning_of(tokens)
    while tokens and tokens[0].kind == "space":
        tokens = tokens[1:]
    verb = tokens[0].text.lower()
    return {"insert": insert, "update": update, "delete": delete}[verb](db, tokens, items, render(prefix), args, force_wipe)


# INSERT


def insert(db, tokens: list[Token], items: list[Token] | None, prefix: str, args: dict, force_wipe: bool) -> DataFrame | None:
    conflict = None
    if (i := find(tokens, "on", "conflict")) >= 0:
        conflict = conflict_of(tokens[i:])
        tokens = tokens[:i]
    elif find(tokens, "on", "duplicate") >= 0:
        raise SqlError("write ON CONFLICT (columns) DO UPDATE, which names the key")
    i = find(tokens, "into")
    rest = [t for t in tokens[i + 1 :]]
    at = behind(rest, 0, 1)
    name = name_of(rest[at - 1])
    s = solid(rest[at:])
    if not s or s[0].kind != "group" or solid(s[0].body)[0].is_word("select", "with"):
        raise SqlError("INSERT needs a list of columns")
    columns = [name_of(solid(c)[0]) for c in split(s[0].body)]
    if len(set(columns)) < len(columns):
        raise SqlError("a column is named twice")
    source = rest[behind(rest, at, 1) :]
    if solid(source)[0].is_word("values"):
        df, kinds = from_values(db, [t for t in solid(source)[1:] if t.kind == "group"], columns, prefix, args)
    else:
        df, kinds = from_select(db, source, columns, prefix, args)
    return write(db, name, df, kinds, conflict, items, force_wipe)


def from_values(db, rows: list[Token], columns: list[str], prefix: str, args: dict) -> tuple[DataFrame, list[dict[str, Kind]]]:
    """The rows of VALUES with _ord, and the kinds of each row, since rows count one by one."""
    exprs, kinds = [], []
    for r in rows:
        cells = split(r.body)
        if len(cells) != len(columns):
            raise SqlError(f"{len(columns)} columns, {len(cells)} values")
        json_cells = [is_json(c) for c in cells]
        exprs.append([render(translated(c)).strip() for c in cells])
        kinds.append({c: Kind.JSON if j else literal_kind(solid(x)) for c, x, j in zip(columns, cells, json_cells, strict=True)})
    for e, k in zip(exprs, kinds, strict=True):
        if None in k.values():  # expressions: Spark tells their types; no job runs
            schema = db.spark.sql(f"{prefix} SELECT {', '.join(e)}", args=args).schema
            k.update({c: kind_of_type(f.dataType) for (c, old), f in zip(k.items(), schema, strict=True) if old is None})
    final = {c: max((k[c] for k in kinds), default=Kind.NULL) for c in columns}
    cell = lambda e, c: f"CAST({e} AS {TYPES[final[c]].simpleString()}) AS `{c}`"
    if not prefix and all(k is not None for row in kinds for k in row.values()) and len(exprs) > 1:
        text = f"SELECT posexplode(array({', '.join('named_struct(' + ', '.join(f'{chr(39)}{c}{chr(39)}, CAST({x} AS {TYPES[final[c]].simpleString()})' for x, c in zip(e, columns, strict=True)) + ')' for e in exprs)})) AS (_ord, _row)"
        return db.spark.sql(text, args=args).select(F.col("_ord").cast("long"), "_row.*"), kinds
    text = " UNION ALL ".join(f"SELECT {n}L AS _ord, " + ", ".join(cell(x, c) for x, c in zip(e, columns, strict=True)) for n, e in enumerate(exprs))
    return db.spark.sql(f"{prefix} {text}", args=args), kinds


def literal_kind(s: list[Token]) -> Kind | None:
    """The kind of a literal, None for other expressions."""
    if len(s) == 2 and s[0].text in "+-" and s[1].kind == "number":
        s = s[1:]
    if len(s) != 1:
        return None
    t = s[0]
    if t.kind == "number":
        return Kind.INT if t.text.isdigit() or t.text[:2].lower() == "0x" else Kind.FLOAT
    if t.kind == "string":
        return Kind.STRING
    if t.is_word("null"):
        return Kind.NULL
    return Kind.BOOL if t.is_word("true", "false") else None


def from_select(db, source: list[Token], columns: list[str], prefix: str, args: dict) -> tuple[DataFrame, list[dict[str, Kind]]]:
    df = db.spark.sql(f"{prefix} {render(translated(source))}", args=args)
    if any(t.text == "*" for t in solid(source)[1:2]):
        raise SqlError("INSERT ... SELECT needs named columns, not *")
    if len(df.columns) != len(columns):
        raise SqlError(f"{len(columns)} columns, {len(df.columns)} selected")
    kinds = {c: kind_of_type(f.dataType) for c, f in zip(columns, df.schema, strict=True)}
    df = df.toDF(*columns).withColumn("_ord", F.monotonically_increasing_id())
    return df, [kinds]


def insert_rows(db, name: str, rows: list[dict], force_wipe: bool) -> None:
    """Python dictionaries as rows."""
    with db._lock:
        columns = list(dict.fromkeys(c.lower() for r in rows for c in r))
        kinds = [{c.lower(): kind_of_value(v) for c, v in r.items()} for r in rows]
        final = {c: max((k.get(c, Kind.NULL) for k in kinds), default=Kind.NULL) for c in columns}
        data = [(n, *(cast_value(final[c], {k.lower(): v for k, v in r.items()}.get(c)) for c in columns)) for n, r in enumerate(rows)]
        schema = T.StructType([T.StructField("_ord", T.LongType()), *(T.StructField(c, TYPES[final[c]]) for c in columns)])
        write(db, name, db.spark.createDataFrame(data, schema), kinds, None, None, force_wipe)


def cast_value(kind: Kind, v: object) -> object:
    if v is None:
        return None
    if kind == Kind.FLOAT:
        return float(v)
    if kind == Kind.INT:
        return int(v)
    if kind == Kind.JSON:
        return json.dumps(v, sort_keys=True)
    if kind == Kind.DATE and not isinstance(v, datetime.datetime):
        return datetime.datetime(v.year, v.month, v.day)
    return v if kind in (Kind.BOOL, Kind.DATE) else str(v)


def write(db, name: str, df: DataFrame, kinds: list[dict[str, Kind]], conflict: Conflict | None, items: list[Token] | None, force_wipe: bool) -> DataFrame | None:
    table = db.tables.get(name, Table(None, locked=db.locked))
    wiped, after = False, table
    for k in kinds:  # rows change the schema one after the other
        new, wipe = evolve(name, after, k, force_wipe)
        after, wiped = after.but(kinds=new), wiped or wipe
    target = reshaped(db, table, after.kinds, wiped)
    incoming = df.select("_ord", *(F.col(c).cast(TYPES[k]).alias(c) if c in df.columns else F.lit(None).cast(TYPES[k]).alias(c) for c, k in after.kinds.items()))
    if conflict:
        incoming = stored(incoming, name)
        check_enums(name, table, incoming)
        return upsert(db, name, target, incoming, conflict, items)
    return append(db, name, target, incoming, items)


def append(db, name: str, target: Table, incoming: DataFrame, items: list[Token] | None) -> DataFrame | None:
    # Values and client rows are few; selected rows may be many and get numbers without a shuffle.
    rows = incoming.withColumn("_rid", F.col("_ord") + F.lit(target.next_rid)).drop("_ord")
    rows = stored(rows.select("_rid", *target.kinds), name)
    check_enums(name, target, rows)  # what is stored, since a source may give other rows when it runs again
    top, count = rows.agg(F.max("_rid"), F.count(F.lit(1))).first()
    following = target.next_rid if top is None else top + 1
    parts = (target.parts or ((target.df, target.next_rid),) if target.next_rid else ()) + ((rows, count),)
    parts = merged(name, parts)
    df = parts[0][0]
    for part, _ in parts[1:]:
        df = df.unionByName(part)
    db.publish(name, target.but(df=df, next_rid=following, parts=parts))
    return returned(rows.withColumnRenamed("_rid", "_at"), items) if items is not None else None


def merged(name: str, parts: tuple[tuple[DataFrame, int], ...]) -> tuple[tuple[DataFrame, int], ...]:
    """At most PARTS parts: beyond, the last ones are written as one, as far back as a part has not more than
    twice the rows of all behind it. So a large table is not written again for small inserts, and a row is
    written a logarithmic number of times."""
    if len(parts) <= PARTS:
        return parts
    i, total = len(parts) - 1, parts[-1][1]
    while i and (parts[i - 1][1] <= 2 * total or len(parts) - i < PARTS // 2):
        i -= 1
        total += parts[i][1]
    df = parts[i][0]
    for part, _ in parts[i + 1 :]:
        df = df.unionByName(part)
    return (*parts[:i], (stored(df, name), total))


def conflict_of(tokens: list[Token]) -> Conflict:
    do = find(tokens, "do")
    if do < 0:
        raise SqlError("ON CONFLICT needs DO")
    group = next((t for t in solid(tokens[:do]) if t.kind == "group"), None)
    columns = [name_of(solid(c)[0]) for c in split(group.body)] if group else []
    action = solid(tokens[do:])
    if action[1].is_word("nothing"):
        return Conflict(columns, nothing=True)
    if not columns:
        raise SqlError("ON CONFLICT DO UPDATE needs columns")
    i = find(tokens, "set", start=do)
    body = tokens[i + 1 :]
    w = find(body, "where")
    where = body[w + 1 :] if w >= 0 else None
    sets = []
    for part in split(body[:w] if w >= 0 else body):
        k = next(k for k, t in enumerate(part) if t.kind == "op" and t.text == "=")
        sets.append((name_of(solid(part[:k])[-1]), part[k + 1 :]))
    return Conflict(columns, sets, where)


def incoming_only(tokens: list[Token]) -> list[Token]:
    """EXCLUDED.c and VALUES(c) as plain columns of the incoming row."""
    out: list[Token] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t.is_word("excluded") and i + 2 < len(tokens) and tokens[i + 1].text == ".":
            out.append(tokens[i + 2])
            i += 3
            continue
        if t.is_word("values") and i + 1 < len(tokens) and tokens[i + 1].kind == "group":
            out += tokens[i + 1].body
            i += 2
            continue
        if t.kind == "group":
            t = Token("group", "", incoming_only(t.body))
        out.append(t)
        i += 1
    return out


def upsert(db, name: str, target: Table, incoming: DataFrame, conflict: Conflict, items: list[Token] | None) -> DataFrame | None:
    """Tuples of equal keys apply one after the other. Keys match NULL with NULL; of equal target rows the first
    is updated. SET reads the incoming row, WHERE the existing one.

    As SET sees the incoming row alone, one pass does for all tuples of a key: the first is inserted where the
    key is new, and the last one's SET stands. Only a WHERE, or a SET of key columns, depends on what the tuple
    before left: then round k takes the k-th tuple of every key."""
    columns = list(target.kinds)
    keys = conflict.columns or columns
    if missing := [k for k in keys if k not in columns]:
        raise SqlError(f"{name} has no column {missing[0]}")
    rounds = 1
    if conflict.sets and (conflict.where or {c for c, _ in conflict.sets} & set(keys)):
        incoming = stored(incoming.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy("_ord"))), name)
        rounds = incoming.agg(F.max("_turn")).first()[0] or 0
    current, following = target.df, target.next_rid
    touched: DataFrame | None = None
    for turn in range(1, rounds + 1):
        batch = incoming.where(F.col("_turn") == turn).drop("_turn") if "_turn" in incoming.columns else incoming
        current, following, now = pass_of(db, name, target, current, following, batch, conflict, keys, items is not None)
        if items is not None:
            touched = now if touched is None else touched.unionByName(now)
    if conflict.sets:
        check_enums(name, target, current)
    db.publish(name, target.but(df=current, next_rid=following, parts=()))
    if items is None:
        return None
    if touched is None:
        return returned(current.limit(0).withColumnRenamed("_rid", "_at"), items)
    return returned(current.join(touched, "_rid").drop("_rid").withColumnRenamed("_by", "_at"), items)


def pass_of(db, name: str, target: Table, current: DataFrame, following: int, batch: DataFrame, conflict: Conflict, keys: list[str], tell: bool) -> tuple[DataFrame, int, DataFrame | None]:
    """One pass over the table: its rows afterwards, the next row number, and (_rid, _by) of every tuple that
    took effect."""
    columns, changed = list(target.kinds), [c for c, _ in conflict.sets]
    # SET expressions see the incoming row alone, WHERE the existing row alone: evaluated on either side.
    batch.createOrReplaceTempView("_incoming")
    sets = [f"({render(translated(incoming_only(tokenize(render(e)))))}) AS `_set_{c}`" for c, e in conflict.sets]
    tuples = db.spark.sql(f"SELECT *, {', '.join(sets)} FROM _incoming AS {name}") if sets else batch
    named = [F.col(k).alias(f"_k_{k}") for k in keys]
    first = F.min_by(F.struct("_ord", *columns), "_ord").alias("_first")
    last = F.max_by(F.struct("_ord", *(f"_set_{c}" for c in changed)), "_ord").alias("_last")
    new = tuples.groupBy(*named).agg(first, last, F.count(F.lit(1)).alias("_tuples"))
    current.createOrReplaceTempView("_existing")
    allowed = f"coalesce(({render(translated(tokenize(render(conflict.where))))}), false)" if conflict.where else "true"
    old = db.spark.sql(f"SELECT *, {allowed} AS _allowed FROM _existing AS {name}")

    def same(left: DataFrame, right: DataFrame):
        out = F.lit(True)
        for k in keys:
            out = out & left[k].eqNullSafe(right[f"_k_{k}"])
        return out

    # The keys that come in meet the table once; what is joined later is a row for each of them.
    known = old.select("_rid", *keys).join(new.select(*(f"_k_{k}" for k in keys)), same(old, new)).groupBy(*(f"_k_{k}" for k in keys)).agg(F.min("_rid").alias("_hit"))
    known = known.withColumnsRenamed({f"_k_{k}": f"_known_{k}" for k in keys})
    both = F.lit(True)
    for k in keys:
        both = both & F.col(f"_k_{k}").eqNullSafe(F.col(f"_known_{k}"))
    matched = stored(new.join(known, both, "left").select(*(f"_k_{k}" for k in keys), "_first", "_last", "_tuples", "_hit"), name)
    hits = matched.where("_hit IS NOT NULL").select("_hit", "_last")
    merged = old.join(hits, old["_rid"] == hits["_hit"], "left")
    act = F.col("_hit").isNotNull() & F.col("_allowed") & F.lit(not conflict.nothing)
    values = [F.when(act, F.col(f"_last._set_{c}").cast(TYPES[target.kinds[c]])).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in columns]
    merged = merged.select("_rid", *values, F.when(act, F.col("_last._ord")).alias("_by"))
    again = F.col("_tuples") > 1
    values = [F.when(again, F.col(f"_last._set_{c}").cast(TYPES[target.kinds[c]])).otherwise(F.col(f"_first.{c}")).alias(c) if c in changed else F.col(f"_first.{c}").alias(c) for c in columns]
    fresh = matched.where("_hit IS NULL").select((F.col("_first._ord") + F.lit(following)).alias("_rid"), *values, F.col("_first._ord").alias("_by"))
    step = stored(merged.unionByName(fresh), name)
    top = step.agg(F.max("_rid")).first()[0]
    now = None
    if tell:
        effect = step.where("_by IS NOT NULL").select("_rid", "_by")
        if conflict.nothing:
            now = effect
        else:  # every tuple of a key shows the row that it has in the end
            rids = matched.select(*(f"_k_{k}" for k in keys), F.coalesce("_hit", F.col("_first._ord") + F.lit(following)).alias("_rid")).join(effect.select("_rid"), "_rid", "left_semi")
            now = batch.join(rids, same(batch, rids)).select("_rid", F.col("_ord").alias("_by"))
    return step.drop("_by"), max(following, -1 if top is None else top) + 1, now


# UPDATE and DELETE


def update(db, tokens: list[Token], items: list[Token] | None, prefix: str, args: dict, force_wipe: bool) -> DataFrame | None:
    i = find(tokens, "set")
    head = solid(tokens[1:i])
    name, alias = name_of(head[0]), name_of(head[-1])
    table = db.tables.get(name)
    if table is None or table.df is None:
        raise SqlError(f"there is no table {name}")
    body = tokens[i + 1 :]
    w = find(body, "where")
    test = render(translated(body[w + 1 :])) if w >= 0 else "true"
    assigned, kinds = [], dict(table.kinds)
    for part in split(body[:w] if w >= 0 else body):
        k = next(k for k, t in enumerate(part) if t.kind == "op" and t.text == "=")
        assigned.append((name_of(solid(part[:k])[-1]), render(translated(part[k + 1 :])).strip()))
    table = reshaped(db, table, table.kinds)
    table.df.createOrReplaceTempView("_existing")
    text = f"SELECT *, coalesce(({test}), false) AS _hit FROM _existing AS {alias}"
    for column, expr in assigned:  # from left to right, each seeing the ones before
        if column not in kinds:
            raise SqlError(f"{name} has no column {column}")
        text = f"SELECT * EXCEPT (`{column}`), CASE WHEN _hit THEN ({expr}) ELSE `{column}` END AS `{column}` FROM ({text}) AS {alias}"
    done = db.spark.sql(f"{prefix} {text}", args=args)
    after = table
    for column, _ in assigned:
        kind = kind_of_type(done.schema[column].dataType)
        new, _ = evolve(name, after, {column: kind if table.kinds[column] not in (Kind.JSON, Kind.DATE) or kind != Kind.STRING else table.kinds[column]}, False)
        after = after.but(kinds=new)
    done = stored(done.select("_rid", *(F.col(c).cast(TYPES[k]).alias(c) for c, k in after.kinds.items()), "_hit"), name)
    check_enums(name, table, done)
    db.publish(name, after.but(df=done.drop("_hit"), parts=()))
    return returned(done.where("_hit").drop("_hit").withColumnRenamed("_rid", "_at"), items) if items is not None else None


def delete(db, tokens: list[Token], items: list[Token] | None, prefix: str, args: dict, force_wipe: bool) -> DataFrame | None:
    i = find(tokens, "from")
    w = find(tokens, "where")
    head = solid(tokens[i + 1 : w if w >= 0 else len(tokens)])
    name, alias = name_of(head[0]), name_of(head[-1])
    table = db.tables.get(name)
    if table is None or table.df is None:
        raise SqlError(f"there is no table {name}")
    test = render(translated(tokens[w + 1 :])) if w >= 0 else "true"
    table = reshaped(db, table, table.kinds)
    table.df.createOrReplaceTempView("_existing")
    done = stored(db.spark.sql(f"{prefix} SELECT *, coalesce(({test}), false) AS _hit FROM _existing AS {alias}", args=args), name)
    db.publish(name, table.but(df=done.where("NOT _hit").drop("_hit"), parts=()))
    return returned(done.where("_hit").drop("_hit").withColumnRenamed("_rid", "_at"), items) if items is not None else None
