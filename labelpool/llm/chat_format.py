"""Chat formatting with a grammar round trip: conversations as training text that reads back exactly.

A conversation is formatted as its turns one after another, every turn a text between the
opening and the closing control string of its role::

    <<SYS>>text<</SYS>>   [INST]text[/INST]   <s>text</s>        (system, user, assistant)
    <<ROLE>>role<</ROLE>><<TEXT>>text<</TEXT>>                   (any other role)

The parser is deterministic: it cuts the formatted text at every control string, wherever
one stands. The text is in the grammar if the control strings are pairs of an opening and
its own closing one with nothing between pairs; what lies inside the pairs, unescaped, are
the turns. Whatever a text itself holds of these strings is therefore seen and escaped:

1. Each turn is rendered as it stands and parsed again. If what comes back isn't the turn,
   its text conflicts and is escaped, and the turn is rendered anew.
2. The turns of a conversation are joined and the whole is parsed again. Where the turns
   differ from the source, all of the conversation's turns are escaped and it is parsed
   once more; one that then still differed would fail the job.

An escape puts a backslash behind the first character of a control string, or of one that
has backslashes there already; the parser takes one away. No control string is another's
end and beginning, so an escaped text holds none, and taking the backslashes away gives
the text. Every text reads back, whatever it holds.

The loss mask covers each assistant text, without its control strings: ``segments`` are the
formatted text in order, marked whether they count.

All is DataFrame functions. Turns are rendered and parsed row by row before they meet; then
one shuffle brings a conversation's turns together, since its text is one value. A
conversation must fit in a row; other sizes don't matter, and copies are conversations of
their own.

Defined results: a null text or role is empty; turns come by number, then role, then text,
a null number first; repeated rows are turns of their own; rows without a conversation id
are one conversation; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The grammar's control strings, each opening one and its closing one.
ROLE_MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
NAME_MARKS, TEXT_MARKS = ("<<ROLE>>", "<</ROLE>>"), ("<<TEXT>>", "<</TEXT>>")
CONTROL = r"</?s>|\[/?INST\]|<</?(?:SYS|ROLE|TEXT)>>"
_REST = {"<": r"\\*(?:/?s>|</?(?:SYS|ROLE|TEXT)>>)", r"\[": r"\\*/?INST\]"}   # what follows a control string's first character
SHOWN_CONTROL = "|".join(first + rest for first, rest in _REST.items())   # a control string, escaped or not
_GAP = "|".join(f"(?<={first})(?={rest})" for first, rest in _REST.items())
_BACKSLASH = "|".join(rf"(?<={first})\\(?={rest})" for first, rest in _REST.items())
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _GAP, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _BACKSLASH, "")


def _mark(role: Column, side: int) -> Column:
    """What stands before (0) or behind (1) a turn's text."""
    out = F.lit(TEXT_MARKS[1]) if side else F.concat(F.lit(NAME_MARKS[0]), escape(role), F.lit(NAME_MARKS[1] + TEXT_MARKS[0]))
    for name, pair in ROLE_MARKS.items():
        out = F.when(role == name, F.lit(pair[side])).otherwise(out)
    return out


def _pieces(role: Column, text: Column) -> Column:
    """A turn's (text, loss) pieces; ``text`` as it is to stand."""
    piece = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    return F.array(piece(_mark(role, 0), F.lit(False)), piece(text, role == LEARNED_ROLE), piece(_mark(role, 1), F.lit(False)))


def _joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p.text), "")


def with_turns(df: DataFrame, formatted: str, out: str) -> DataFrame:
    """Add the turns (role, text) of a formatted text; null if it isn't in the grammar."""
    df = df.withColumn("_marks", F.regexp_extract_all(F.col(formatted), F.lit(CONTROL), F.lit(0)))
    df = df.withColumn("_texts", F.split(F.col(formatted), CONTROL, -1))
    df = df.withColumn("_pairs", _pairs_of(F.col("_marks"), F.col("_texts")))
    return df.withColumn(out, _turns_of(F.col("_pairs"), F.element_at("_texts", -1))).drop("_marks", "_texts", "_pairs")


def _is_name(pair: Column) -> Column:
    return pair.open == NAME_MARKS[0]


def _is_named(pair: Column) -> Column:
    return pair.open == TEXT_MARKS[0]


def _pairs_of(marks: Column, texts: Column) -> Column:
    """Every second control string with the next one, the text between them, and what stands before them."""
    return F.filter(F.transform(marks, lambda m, i: F.struct(
        i.alias("at"), m.alias("open"), F.get(marks, i + 1).alias("close"), F.get(texts, i + 1).alias("text"),
        F.get(texts, i).alias("gap"), F.get(marks, i - 1).alias("before"), F.get(texts, i - 1).alias("name"))), lambda p: p.at % 2 == 0)


def _turns_of(pairs: Column, end: Column) -> Column:
    """The turns of the pairs and of what follows the last one."""
    closing = F.create_map(*(F.lit(x) for pair in [*ROLE_MARKS.values(), NAME_MARKS, TEXT_MARKS] for x in pair))
    roles = F.create_map(*(F.lit(x) for r, (opening, _) in ROLE_MARKS.items() for x in (opening, r)))
    fits = F.forall(pairs, lambda p: (p.gap == "") & F.coalesce(closing[p.open] == p.close, F.lit(False))
                    & (_is_named(p) == F.coalesce(p.before == NAME_MARKS[1], F.lit(False))))
    fits = fits & (end == "") & F.coalesce(F.try_element_at(pairs, F.lit(-1)).open != NAME_MARKS[0], F.lit(True))
    turns = F.transform(F.filter(pairs, lambda p: ~_is_name(p)), lambda p: F.struct(
        F.when(_is_named(p), unescape(p["name"])).otherwise(roles[p.open]).alias("role"), unescape(p.text).alias("text")))
    return F.when(fits, turns)


def _same(turns: Column, source: Column) -> Column:
    return F.coalesce(turns == source, F.lit(False))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """``(conv_id, formatted, segments, n_escaped)``: a row per conversation with its text, the
    text's (text, loss) segments in order, and the number of turns whose text is escaped."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # each turn alone: as it stands, else escaped
    rows = with_turns(rows.withColumn("_alone", _joined(_pieces(F.col("role"), F.col("text")))), "_alone", "_read")
    rows = rows.withColumn("clean", _same(F.col("_read"), F.array(F.struct("role", "text"))))
    rows = rows.withColumn("shown", F.when(F.col("clean"), F.col("text")).otherwise(escape(F.col("text"))))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "clean", "shown"))).alias("turns"))
    whole = whole.withColumn("source", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))))
    # the whole conversation: as chosen, else all turns escaped
    whole = whole.withColumn("_chosen", F.flatten(F.transform("turns", lambda t: _pieces(t.role, t.shown))))
    whole = with_turns(whole.withColumn("_joined", _joined(F.col("_chosen"))), "_joined", "_read")
    whole = whole.withColumn("same", _same(F.col("_read"), F.col("source")))
    everything = F.flatten(F.transform("turns", lambda t: _pieces(t.role, escape(t.text))))
    whole = whole.withColumn("segments", F.when(F.col("same"), F.col("_chosen")).otherwise(everything))
    whole = whole.withColumn("formatted", F.when(F.col("same"), F.col("_joined")).otherwise(_joined(F.col("segments"))))
    whole = with_turns(whole, "formatted", "_read")
    read = F.when(_same(F.col("_read"), F.col("source")), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't read back")))
    n_escaped = F.when(F.col("same"), F.size(F.filter("turns", lambda t: ~t.clean))).otherwise(F.size("turns"))
    return whole.select("conv_id", read.alias("formatted"), "segments", n_escaped.cast("long").alias("n_escaped"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its mask give back: ``turns`` by the parser and
    ``learned``, the unescaped texts under the mask, beside the columns of ``formatted``."""
    learned = F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text))
    return with_turns(formatted, "formatted", "turns").withColumn("learned", learned)


def chat_report(turns: DataFrame) -> DataFrame:
    """Per conversation the digests of what is read back from its formatted text."""
    back = read_back(format_conversations(turns))
    back = back.withColumn("lines", F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""))
    back = back.withColumn("loss", F.array_join("learned", ""))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.col("lines").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_escaped")
