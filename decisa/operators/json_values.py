"""JSON texts as rows: every value's pointer and byte span, by a lexer of column expressions and windows over tokens.

A text is taken apart by one regular expression into tokens, white space among them, so the sizes of the tokens before it
are a token's place. Running sums of brackets give its level; the last key, or the commas since the last bracket, of each
level give the path. One shuffle by row, then windows in it: nothing is parsed twice, however many values are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A whole string, a mark, white space, or anything else up to one of these.
TOKEN = r'"(?:[^"\\]++|\\.)*+"|[{}\[\],:]|[ \t\r\n]++|[^ \t\r\n{}\[\],:"]++|"'
#: A string by the rules of JSON, without surrogates that stand alone.
STRING = r'^"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})*+"$'
NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?$"
#: Digits of an integer that may be read at most.
MOST_DIGITS = 4300


def unquoted(token: Column) -> Column:
    """The text of a string token."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(F.instr(token, "\\") == 0, plain).otherwise(F.from_json(F.concat(F.lit('{"k":'), token, F.lit("}")), "k string")["k"])


def _sound(token: Column) -> Column:
    """Whether a token that isn't a mark is a string, a literal or a finite number."""
    number = token.rlike(NUMBER) & (F.length(token) <= MOST_DIGITS) & (F.abs(token.try_cast("double")) < float("inf"))
    return F.when(token.startswith('"'), token.rlike(STRING)).otherwise(token.isin("true", "false", "null") | F.coalesce(number, F.lit(False)))


def values(df: DataFrame, raw: str, depth: int = 7) -> DataFrame:
    """df's other columns with (_row, _valid, lv, path, kind, start, stop, token, empty): a row a value.

    _row numbers df's rows. lv is the length of the path, whose items are unescaped keys, or indices as decimal text;
    values deeper than `depth` have no row. kind: object, array, string, number, boolean, null. The value's bytes in the
    UTF-8 text are start to stop, without stop. token is a scalar's own text; empty tells a container without members.
    _valid, the same in all rows of a text: it is one JSON value without repeated keys, lone surrogates, control
    characters in strings, or numbers that aren't finite. A text that is null or empty has one row with nulls.
    Texts that aren't valid have rows too, without meaning."""
    others = [c for c in df.columns if c != raw]
    text, token = F.col("_raw"), F.col("token")
    rows = df.select(*others, F.col(raw).cast("string").alias("_raw")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_parsed", F.try_parse_json(text).isNotNull())
    tokens = rows.select(*others, "_row", "_parsed", F.posexplode_outer(F.when(text.rlike(r"[^ \t\r\n]"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))).alias("n", "token"))
    opens, closes = token.isin("{", "["), token.isin("}", "]")
    places = Window.partitionBy("_row").orderBy("n")
    by_row = places.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = F.sum(opens.cast("int") - closes.cast("int")).over(by_row)
    size = F.octet_length("token")
    tokens = tokens.withColumns({"start": F.sum(size).over(by_row) - size, "lv": up - opens.cast("int")})
    tokens = tokens.filter(token.isNull() | ~token.rlike(r"^[ \t\r\n]"))
    mark = opens | closes | token.isin(",", ":")
    levels = range(1, depth + 1)
    key = F.coalesce(token.startswith('"') & (F.lead("token").over(places) == ":"), F.lit(False))
    commas = {f"_c{k}": F.sum(((token == ",") & (F.col("lv") == k)).cast("int")).over(by_row) for k in levels}
    tokens = tokens.withColumns({"_key": key, "_first": F.row_number().over(places) == 1, "_next": F.lead("token").over(places), **commas})
    last = lambda test, what: F.last(F.when(test, what), ignorenulls=True).over(by_row)
    names = {}
    for k in levels:
        opened = opens & (F.col("lv") == k - 1)
        keyed = last(F.col("_key") & (F.col("lv") == k), token)
        names[f"_n{k}"] = F.when(last(opened, token) == "{", keyed).otherwise((F.col(f"_c{k}") - last(opened, F.col(f"_c{k}"))).cast("string"))
    backward = Window.partitionBy("_row", "lv").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("_row")
    own = ~mark & ~F.col("_key")
    flaws = (~mark & ~_sound(token)) | (F.col("lv") < 0) | ((F.col("lv") == 0) & token.isin(",", ":"))
    tops = F.sum(((opens | own) & (F.col("lv") == 0)).cast("int")).over(whole)
    tokens = tokens.withColumns({
        **names,
        "_end": F.last(F.when(closes, F.col("start") + 1), ignorenulls=True).over(backward),
        "_valid": F.coalesce(F.col("_parsed") & (tops == 1) & ~F.coalesce(F.max(flaws).over(whole), F.lit(False)), F.lit(False)),
    })
    name = lambda k: F.when(F.col(f"_n{k}").startswith('"'), unquoted(F.col(f"_n{k}"))).otherwise(F.col(f"_n{k}"))
    kind = (
        F.when(token == "{", "object").when(token == "[", "array").when(token.startswith('"'), "string")
        .when(token.isin("true", "false"), "boolean").when(token == "null", "null").when(token.isNotNull(), "number")
    )
    return tokens.filter(F.col("_first") | ((opens | own) & (F.col("lv") <= depth))).select(
        *others, "_row", "_valid", F.when(opens | own, F.col("lv")).alias("lv"), F.when((opens | own) & (F.col("lv") >= 0), F.slice(F.array(*[name(k) for k in levels]), F.lit(1), F.greatest("lv", F.lit(0)))).alias("path"),
        kind.alias("kind"), "start", F.when(opens, F.col("_end")).otherwise(F.col("start") + F.octet_length("token")).alias("stop"),
        F.when(~opens, token).alias("token"), F.when(opens, F.col("_next").isin("}", "]")).alias("empty"),
    )


def pointer(path: Column) -> Column:
    """A path as a JSON pointer."""
    escaped = F.transform(path, lambda p: F.concat(F.lit("/"), F.replace(F.replace(p, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))))
    return F.array_join(escaped, "")


def truthy(kind: Column, token: Column, empty: Column) -> Column:
    """Whether a value isn't null, false, zero, or an empty string, array or object."""
    zero = (kind == "number") & (token.try_cast("double") == 0)
    return kind.isNotNull() & ~reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in (empty, token.isin("null", "false", '""'), zero)])
