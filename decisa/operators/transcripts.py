"""Session transcripts: events flattened to segments, tool operations read from calls, proposals mined from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisa.functions.jsons import canonical, items_at, kind, member, parse, string_at

# Prefixes of texts that a harness writes in a user's name, and the limits of a transcript.
CONTROL_PREFIXES = (
    "<local-command-caveat", "<local-command-stdout", "<local-command-stderr", "<command-name", "<command-message", "<command-args", "<command-contents",
    "<task-notification", "<bash-input", "<bash-stdout", "<bash-stderr", "<ide_opened_file", "<ide_selection",
)
# Prefixes of message parts that a harness writes in the second grammar.
RESPONSE_CONTROL_PREFIXES = (
    "<codex_internal_context", "<environment_context", "<turn_aborted", "<recommended_plugins", "<subagent_notification", "<in-app-browser-context",
    "<image", "</image", "<permissions", "<app-context", "<collaboration", "# AGENTS.md instructions", "# Files mentioned", "# In app browser",
)
MOST_SEGMENTS, MOST_BYTES = 4_000, 1_000_000

# Names of tools, in lower case, and what marks reading and listing in a command line.
READ_NAMES = ("read", "view", "open_file", "cat", "read_file")
EDIT_NAMES = ("edit", "multiedit", "write", "notebookedit", "str_replace_editor", "apply_patch", "patch", "update_file", "insert_edit_into_file", "create_file")
LIST_NAMES = ("list_dir", "list_directory", "glob", "ls")
SHELL_NAMES = (
    "bash", "shell", "exec", "exec_command", "local_shell", "cmd", "run_terminal_cmd", "js", "node", "write_stdin", "powershell", "terminal", "container.exec",
    "sh", "zsh", "run_command", "process", "container",
)
PATH_FIELDS = ("file_path", "path", "filename", "filepath", "target_file", "notebook_path")
PATH = r"(?<![\w./-])(?:[A-Za-z0-9_.~-]+/)+[A-Za-z0-9_./~-]+"
PATCHED = r"\*\*\*\s*(?:Update|Add|Delete|Move)\s+File:\s*(\S+)"
READS = r"\b(?:sed\s+-n|cat|head|tail|less|more|bat|awk|nl)\b|open\(|read_text\(|Path\("
LISTS = r"\b(?:ls|dir|find|tree|fd)\b|--files\b"

BLOCKS = "array<struct<role: string, kind: string, text: string>>"


def is_control(text: Column, prefixes: tuple[str, ...] = CONTROL_PREFIXES) -> Column:
    """Whether a text begins, after white space, as a harness's own."""
    bare = F.regexp_replace(text, r"^\s+", "")
    out = F.lit(False)
    for prefix in prefixes:
        out = out | bare.startswith(prefix)
    return out


def _block(role: str, kind_: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.lit(kind_).alias("kind"), text.alias("text"))


def _result_text(block: Column) -> Column:
    """A tool result's text: itself, its text blocks by lines, or its canonical JSON."""
    parts = F.filter(F.coalesce(items_at(block, "$.content"), F.array().cast("array<variant>")), lambda p: F.coalesce(string_at(p, "$.type") == "text", F.lit(False)))
    lines = F.array_join(F.transform(parts, lambda p: F.coalesce(string_at(p, "$.text"), F.lit(""))), "\n")
    return F.coalesce(string_at(block, "$.content"), F.when(F.size(parts) > 0, lines), F.to_json(member(block, "$.content")), F.lit(""))


def _call(name: Column, input_: Column) -> Column:
    """A tool call's JSON, keys in order."""
    return F.concat(F.lit('{"tool_use":{"input":'), F.coalesce(F.to_json(input_), F.lit("null")), F.lit(',"name":'), F.coalesce(F.to_json(name), F.lit("null")), F.lit("}}"))


def _of_events(v: Column) -> Column:
    """The blocks of one session event: an assistant's text and tool_use blocks, a user's texts and tool results; other
    events, compact summaries, meta and system prompts and texts that a harness writes for a user give none."""
    content, type_ = member(v, "$.message.content"), lambda p: string_at(p, "$.type")
    parts = F.coalesce(items_at(v, "$.message.content"), F.array().cast("array<variant>"))
    truthy = lambda path: F.coalesce(member(v, path, "boolean"), F.lit(False))
    none = F.lit(None).cast("struct<role: string, kind: string, text: string>")
    said = F.transform(parts, lambda p: F.when(type_(p) == "text", _block("assistant", "assistant_text", string_at(p, "$.text"))).when(type_(p) == "tool_use", _block("assistant", "tool_use", _call(member(p, "$.name"), member(p, "$.input")))).otherwise(none))
    turn = lambda t: F.when(~is_control(t), _block("user", "user_turn", t)).otherwise(none)
    asked = F.when(kind(content) == "string", F.array(turn(string_at(v, "$.message.content")))).otherwise(
        F.transform(parts, lambda p: F.when(type_(p) == "tool_result", _block("tool", "tool_result", _result_text(p))).when(type_(p) == "text", turn(string_at(p, "$.text"))).otherwise(none))
    )
    event = string_at(v, "$.type")
    meta = truthy("$.isMeta") | truthy("$.isCompactSummary") | F.coalesce(string_at(v, "$.promptSource") == "system", F.lit(False))
    return F.when((event == "assistant") & ~truthy("$.isCompactSummary"), said).when((event == "user") & ~meta, asked).otherwise(F.array().cast(BLOCKS))


def _of_responses(v: Column) -> Column:
    """The blocks of one response item: a user's message is what its parts say beside a harness's own; an assistant's its
    parts, those of a harness only where there are no others; calls and their outputs, web searches and images. Parts are
    joined by empty lines; other roles and items give none."""
    type_, role = string_at(v, "$.payload.type"), string_at(v, "$.payload.role")
    parts = F.filter(F.coalesce(items_at(v, "$.payload.content"), F.array().cast("array<variant>")), lambda p: F.coalesce(string_at(p, "$.text").rlike(r"\S"), F.lit(False)))
    own = lambda p: F.coalesce(string_at(p, "$.type").isin("input_text", "output_text", "text"), F.lit(False)) & ~is_control(string_at(p, "$.text"), RESPONSE_CONTROL_PREFIXES)
    joined = lambda some: F.array_join(F.transform(some, lambda p: string_at(p, "$.text")), "\n\n")
    real, control = joined(F.filter(parts, own)), joined(F.filter(parts, lambda p: ~own(p)))
    at = lambda path: member(v, f"$.payload.{path}")
    input_ = F.coalesce(at("arguments"), at("input"))
    output = F.coalesce(string_at(v, "$.payload.output"), F.to_json(at("output")), F.lit(""))
    named = lambda name, what: _block("assistant", "tool_use", F.concat(F.lit('{"tool_use":{"input":'), F.coalesce(F.to_json(what), F.lit("null")), F.lit(f',"name":"{name}"}}}}')))
    block = (
        F.when((type_ == "message") & (role == "user"), _block("user", "user_turn", real)).when((type_ == "message") & (role == "assistant"), _block("assistant", "assistant_text", F.when(real != "", real).otherwise(control)))
        .when(type_.isin("function_call", "custom_tool_call"), _block("assistant", "tool_use", _call(at("name"), input_))).when(type_.isin("function_call_output", "custom_tool_call_output"), _block("tool", "tool_result", output))
        .when(type_ == "web_search_call", named("web_search", at("action"))).when(type_ == "image_generation_call", named("image_generation", at("revised_prompt")))
    )
    return F.when(string_at(v, "$.type") == "response_item", F.array(block)).otherwise(F.array().cast(BLOCKS))


GRAMMARS = {"events": _of_events, "responses": _of_responses}


def _flat(lines: DataFrame, key: str, pos: str, line: str, grammar: str) -> DataFrame:
    """(key, place, role, kind, text, _upto): blocks in order with the bytes of text up to each; blank texts are left out."""
    rows = lines.select(key, pos, parse(F.col(line)).alias("_v")).filter("_v is not null")
    flat = rows.select(key, pos, F.posexplode(GRAMMARS[grammar](F.col("_v"))).alias("_b", "_s")).filter("_s.text rlike r'\\S'")
    order = Window.partitionBy(key).orderBy(pos, "_b")
    return flat.select(key, (F.row_number().over(order) - 1).alias("place"), "_s.role", "_s.kind", "_s.text", F.sum(F.octet_length("_s.text")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))


def transcript_segments(lines: DataFrame, key: str, pos: str, line: str, most: int = MOST_SEGMENTS, most_bytes: int = MOST_BYTES, grammar: str = "events") -> DataFrame:
    """(key, place, role, kind, text): the ordered segments of sessions, one JSON event a line, in one of two GRAMMARS.

    Lines that aren't JSON and blank texts are left out. A transcript with more than `most` segments or more than
    most_bytes of text gives none; dropped_transcripts() names it. place counts from 0."""
    flat, whole = _flat(lines, key, pos, line, grammar), Window.partitionBy(key)
    flat = flat.withColumns({"_n": F.count(F.lit(1)).over(whole), "_bytes": F.max("_upto").over(whole)})
    return flat.filter((F.col("_n") <= most) & (F.col("_bytes") <= most_bytes)).select(key, "place", "role", "kind", "text")


def dropped_transcripts(lines: DataFrame, key: str, pos: str, line: str, most: int = MOST_SEGMENTS, most_bytes: int = MOST_BYTES, grammar: str = "events") -> DataFrame:
    """(key, reason, place): each transcript that transcript_segments() leaves out, by the limit that it meets first:
    segment_count_hard_cap or extracted_text_over_cap, at the segment where it does; no_segments where there is none."""
    flat = _flat(lines, key, pos, line, grammar)
    over = F.when(F.col("place") >= most, "segment_count_hard_cap").when(F.col("_upto") > most_bytes, "extracted_text_over_cap")
    capped = flat.withColumn("reason", over).filter("reason is not null").groupBy(key).agg(F.min_by("reason", "place").alias("reason"), F.min("place").alias("place"))
    silent = lines.select(key).distinct().join(flat.select(key), key, "leftanti").select(key, F.lit("no_segments").alias("reason"), F.lit(None).cast("int").alias("place"))
    return capped.unionByName(silent)


def tool_ops(text: Column) -> Column:
    """The file operations of a tool call's JSON: an array of (op, paths), op being read, edit or list.

    Named tools give their path fields; a command line gives the paths in it, those of a patch as an edit. Leading dots
    and slashes of a path go. Other tools and texts that are no tool call give none."""
    v = parse(text)
    name, input_ = F.lower(F.coalesce(string_at(v, "$.tool_use.name"), F.lit(""))), member(v, "$.tool_use.input")
    fields = F.array_compact(F.array(*[F.trim(string_at(v, f"$.tool_use.input.{f}")) for f in PATH_FIELDS]))
    fields = F.filter(fields, lambda p: p != "")
    command = F.coalesce(string_at(v, "$.tool_use.input"), F.when(kind(input_) != "null", F.to_json(input_)), F.lit(""))
    bare = lambda paths: F.transform(paths, lambda p: F.coalesce(F.nullif(F.regexp_replace(p, r"^[./]+", ""), F.lit("")), p))
    op = lambda kind_, paths: F.struct(F.lit(kind_).alias("op"), bare(paths).alias("paths"))
    empty = F.array().cast("array<struct<op: string, paths: array<string>>>")
    found, patched = F.regexp_extract_all(command, F.lit(PATH), F.lit(0)), F.regexp_extract_all(command, F.lit(PATCHED), F.lit(1))
    or_found = lambda paths: F.when(F.size(paths) > 0, paths).otherwise(found)
    rest = F.filter(found, lambda p: ~F.array_contains(patched, p))
    patch = F.when(F.lower(command).contains("apply_patch") | F.lower(command).contains("*** begin patch"), F.array(op("edit", or_found(patched)))).otherwise(empty)
    read = F.when(command.rlike(READS) & (F.size(rest) > 0), F.array(op("read", rest))).otherwise(empty)
    list_ = F.when(command.rlike(LISTS), F.array(op("list", found))).otherwise(empty)
    ops = (
        F.when(name.isin(*READ_NAMES), F.array(op("read", fields))).when(name.isin(*EDIT_NAMES), F.array(op("edit", fields)))
        .when(name.isin(*LIST_NAMES), F.array(op("list", or_found(fields)))).when(name.isin(*SHELL_NAMES) | (name == ""), F.concat(patch, read, list_))
    )
    return F.coalesce(F.when(kind(member(v, "$.tool_use")) == "object", ops), empty)


def mined_rereads(segments: DataFrame, key: str) -> DataFrame:
    """(key, place, path, strategy, label, evidence): proposals on read calls of transcript_segments().

    A read of a path is stale when the path is edited later (evidence: the first such edit), repeated when it is only
    read again (the first such read), and wanted when neither; labels are drop, drop and keep. Operations meet by
    (key, path) in running windows, so no pair of them is formed."""
    ops = segments.filter("kind = 'tool_use'").select(key, "place", F.inline(tool_ops(F.col("text"))))
    ops = ops.select(key, "place", "op", F.explode("paths").alias("path")).filter("op <> 'list'").distinct()
    later = Window.partitionBy(key, "path").orderBy("place").rangeBetween(1, Window.unboundedFollowing)
    at = lambda op: F.min(F.when(F.col("op") == op, F.col("place"))).over(later)
    ops = ops.withColumns({"_edit": at("edit"), "_read": at("read")}).filter("op = 'read'")
    strategy = F.when(F.col("_edit").isNotNull(), "stale_read").when(F.col("_read").isNotNull(), "repeated_read").otherwise("wanted_read")
    return ops.select(key, "place", "path", strategy.alias("strategy"), F.when(strategy == "wanted_read", "keep").otherwise("drop").alias("label"), F.coalesce("_edit", "_read").alias("evidence"))


def stitched(segments: DataFrame, noise: DataFrame, key: str, place: str = "place", text: str = "text") -> DataFrame:
    """(key, place, text, inserted): each conversation with its noise segments (key, at, text) put in before the segment
    at that place, at the end beyond it; several at one place stand in order of their text. Places are counted anew."""
    own = segments.select(key, F.col(place).alias("_at"), F.lit(1).alias("_own"), F.col(text).alias("text"))
    more = noise.join(segments.select(key).distinct(), key, "leftsemi").select(key, F.col("at").alias("_at"), F.lit(0).alias("_own"), F.col(text).alias("text"))
    order = Window.partitionBy(key).orderBy("_at", "_own", "text")
    return own.unionByName(more).select(key, (F.row_number().over(order) - 1).alias("place"), "text", (F.col("_own") == 0).alias("inserted"))


def contrast_records(segments: DataFrame, key: str, place: str, text: str, labels: DataFrame) -> DataFrame:
    """(key, place, text, label, pair): records of candidates whose text has both labels somewhere, pair being the
    text's hash. labels: (key, place, label)."""
    rows = segments.join(labels, [key, place]).withColumn("pair", F.sha2(text, 256))
    both = rows.groupBy("pair").agg(F.countDistinct("label").alias("_n")).filter("_n > 1").select("pair")
    return rows.join(both, "pair", "leftsemi").select(key, place, text, "label", "pair")


def canonical_line(event: Column) -> Column:
    """A struct as one canonical JSON line."""
    return canonical(F.to_json(event))
