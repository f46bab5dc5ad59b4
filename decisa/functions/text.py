"""Text columns: normal forms, hashes, buckets, extraction, shingles, signatures, scans and classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from decisa.functions.jsons import canonical

# Names and patterns of the secret scan, in the order that decides which one is reported.
SECRETS = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("aws_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("api_key", r"\bsk-[A-Za-z0-9_-]{16,}\b"),
    ("bearer", r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{20,}"),
    ("assignment", r"(?i)\b(?:password|passwd|secret|token|api[_-]?key)\b\s*[:=]\s*\S{6,}"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
)

EXTRACTORS = {
    "url": r"https?://[^\s<>\"')]+",
    "hex": r"\b[0-9a-f]{12,64}\b",
    "path": r"(?:[\w.-]+/)+[\w.-]+",
    "number": r"\b\d+(?:\.\d+)?\b",
    "version": r"\bv?\d+\.\d+(?:\.\d+)+\b",
    "percent": r"\b\d+(?:\.\d+)?%",
    "identifier": r"\b[A-Za-z_]+(?:_[A-Za-z0-9]+)+\b",
}


def normalize(x: Column) -> Column:
    """Lower case, every run of Unicode white space one space, ends stripped."""
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def squash(x: Column) -> Column:
    """White space collapsed, case kept."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def boilerplate_key(x: Column) -> Column:
    """Digits as #, lower case, white space collapsed."""
    return normalize(F.regexp_replace(x, r"\d", "#"))


def hash_bucket(key: Column, seed: str, n: int, digits: int = 8) -> Column:
    """The first hex digits of sha256("seed:key") modulo n; at most 15 digits fit a long."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, digits), 16, 10).cast("long") % n


def digest_mod(key: Column, n: int) -> Column:
    """The whole 256-bit sha256 modulo n, folded digit by digit."""
    code = F.split(F.sha2(key, 256), "")
    return F.aggregate(F.filter(code, lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: (a * 16 + F.conv(c, 16, 10).cast("long")) % n)


def uniform(seed: str, *keys: Column) -> Column:
    """A reproducible draw from [0, 1) by a hash of the seed and the keys (13 hex digits)."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16**13)


def hash_split(key: Column, seed: str, eval_pct: int = 10, dev_pct: int = 10) -> Column:
    """eval, dev or train by the hash bucket of a group."""
    b = hash_bucket(key, seed, 100)
    return F.when(b < eval_pct, "eval").when(b < eval_pct + dev_pct, "dev").otherwise("train")


def secret_kind(x: Column) -> Column:
    """The first pattern in declared order that matches, else null."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in SECRETS:
        out = out.when(x.rlike(pattern), name)
    return out


def extract(x: Column, kind: str) -> Column:
    return F.regexp_extract_all(x, F.lit(EXTRACTORS[kind]), F.lit(0))


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def shingles(x: Column, n: int = 6, most: int | None = None, long_word: int | None = None) -> Column:
    """Distinct runs of n words in order; long_word keeps runs with a word of that length, most the first of them."""
    none = F.array().cast("array<array<string>>")
    # the words are a lambda's variable: an expression inside a lambda would be split again for every run
    runs = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, F.lit(n)))).otherwise(none)
    s = F.get(F.transform(F.array(words(x)), runs), 0)
    if long_word:
        s = F.filter(s, lambda run: F.exists(run, lambda t: F.length(t) >= long_word))
    s = F.array_distinct(F.transform(s, lambda run: F.array_join(run, " ")))
    return F.slice(s, 1, most) if most else s


def char_windows(x: Column, size: int = 10, step: int = 6) -> Column:
    """Windows of `size` characters every `step`, for scripts without spaces. The text is split once: a substring of
    UTF-8 is found from its start, which is quadratic in a long text."""
    cut = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - size + 1, F.lit(step)), lambda i: F.array_join(F.slice(c, i, F.lit(size)), ""))
    return F.when(F.length(x) >= size, F.flatten(F.transform(F.array(F.split(x, "")), cut)))


def language_bucket(x: Column) -> Column:
    return F.when(x.rlike(r"[぀-ヿ]"), "ja").when(x.rlike(r"[가-힯]"), "ko").when(x.rlike(r"[一-鿿]"), "zh").otherwise("other")


def signatures(x: Column, size: int = 60, least: int = 40) -> Column:
    """Up to three distinct chunks: start, middle, end; none for shorter texts."""
    n = F.length(x)
    start, middle, end = F.substring(x, 1, size), F.substring(x, F.greatest(F.lit(1), F.floor(n / 2).cast("int") - size // 2 + 1), F.lit(size)), F.substring(x, F.greatest(F.lit(1), n - size + 1), F.lit(size))
    return F.when(n >= least, F.array_distinct(F.array(start, middle, end))).otherwise(F.array().cast("array<string>"))


def compiled_tokens(prompt: Column) -> Column:
    """Words and marks of a compiled prompt, a stand-in for a tokenizer's count that never leaves the JVM."""
    return F.regexp_count(prompt, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


def canonical_board(cells: Column, side: int) -> Column:
    """The least of a square board's eight turns and mirror images, the board being a text of side * side cells."""
    n = range(side)
    turns = [[(r, c) for r in n for c in n]]
    for _ in range(3):
        turns.append([turns[-1][c * side + side - 1 - r] for r in n for c in n])
    forms = turns + [[f[r * side + side - 1 - c] for r in n for c in n] for f in turns]
    return F.array_min(F.array(*[F.concat(*[F.substring(cells, r * side + c + 1, 1) for r, c in f]) for f in forms]))


def acknowledges(x: Column) -> Column:
    """Short replies that only agree or ask to go on."""
    return (F.length(F.trim(x)) <= 40) & F.trim(x).rlike(r"(?i)^(ok(ay)?|thanks?|thank you|yes|yep|sure|go on|continue|next|great|done)\b")


def word_estimate(x: Column) -> Column:
    """White-space words; 0 for blank and null."""
    return F.coalesce(F.size(words(x)), F.lit(0))


def pointer_index(x: Column) -> Column:
    """The message number of a JSON pointer `/messages/N/content...` or `/input/N/content...`, else null."""
    got = F.regexp_extract(x, r"^/(?:messages|input)/(\d+)/content(?:/\d+/text)?$", 1)
    return F.when(got != "", got.cast("int"))


def band(x: Column, edges: list[tuple[float, str]], rest: str) -> Column:
    """The first name whose edge the value reaches, in the given order."""
    out = F.when(F.lit(False), F.lit(""))
    for edge, name in edges:
        out = out.when(x >= edge, name)
    return F.when(x.isNotNull(), out.otherwise(rest))


def fit_budget(text: Column, budget: int, ladder: tuple[int, ...] = (2000, 500, 120)) -> Column:
    """The text, or the longest prefix of the ladder, whose UTF-8 bytes fit; else empty."""
    options = [F.when(F.octet_length(text) <= budget, text)]
    options += [F.when(F.octet_length(F.substring(text, 1, k)) <= budget, F.substring(text, 1, k)) for k in ladder]
    return F.when(text.isNotNull(), F.coalesce(*options, F.lit("")))


def visible_input(state: Column, type_: Column, instructions: Column, criteria: Column) -> Column:
    """Canonical JSON of what a model sees of a question. state and criteria are JSON texts, criteria {} where it is null;
    null where they aren't JSON or another part is null."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    parts = [F.lit('{"state":'), state, F.lit(',"type":'), quoted(type_), F.lit(',"instructions":'), quoted(instructions), F.lit(',"criteria":'), F.coalesce(criteria, F.lit("{}")), F.lit("}")]
    return F.when(type_.isNotNull() & instructions.isNotNull(), canonical(F.concat(*parts)))


#: What provenance of evaluation sets is called.
EVALUATION_NAMES = ("abstention survey", "workflow challenge", "workflow v2 evaluation", "context relevance test", "context relevance ood")


def evaluation_derived(provenance: Column) -> Column:
    """Whether a provenance holds the name of an evaluation set, in any case and with any run of spaces, hyphens and
    underscores between its words. A null one doesn't."""
    plain = F.regexp_replace(F.lower(F.coalesce(provenance, F.lit(""))), r"[-_\s]+", " ")
    return F.exists(F.array(*map(F.lit, EVALUATION_NAMES)), lambda n: F.contains(plain, n))


#: Spans that a perturbation may change, in the order in which one text is read as one of them.
SPANS = (("path", r"(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+"), ("version", r"v?[0-9]+[.][0-9]+(?:[.][0-9]+)+"), ("number", r"[0-9]+(?:[.][0-9]+)?"))


def perturbed(text: Column, draw: Column) -> Column:
    """(kind, start, before, after, text): a text with one of its paths, versions or numbers changed, and nothing else.

    draw, a number from 0, picks the span: the (draw modulo their number)-th from the left. A path's last part gets `_x`
    before its extension; the last digit of a version or number becomes the next one, 9 becomes 0. start counts
    characters from 0. Null for a text without spans."""
    pattern = "|".join(p for _, p in SPANS)
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    k = F.pmod(draw, F.size(found)).cast("int")
    before = F.get(found, k)
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))
    start = total(F.slice(gaps, F.lit(1), k + 1)) + total(F.slice(found, F.lit(1), k))
    kind = F.lit(None).cast("string")
    for name, p in reversed(SPANS):
        kind = F.when(before.rlike(f"^(?:{p})$"), name).otherwise(kind)
    digit = F.regexp_extract(before, "([0-9])$", 1)
    moved = F.concat(F.substring(before, F.lit(1), F.length(before) - 1), ((digit.try_cast("int") + 1) % 10).cast("string"))
    part = F.concat(F.regexp_extract(before, "^(.*/)", 1), F.regexp_replace(F.regexp_extract(before, "([^/]*)$", 1), r"^([^.]*)(.*)$", "$1_x$2"))
    after = F.when(kind == "path", part).otherwise(moved)
    whole = F.concat(F.substring(text, F.lit(1), start), after, F.substring(text, start + F.length(before) + 1, F.length(text)))
    return F.when(F.size(found) > 0, F.struct(kind.alias("kind"), start.cast("long").alias("start"), before.alias("before"), after.alias("after"), whole.alias("text")))
