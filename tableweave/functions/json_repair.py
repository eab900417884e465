"""Where a text stops being JSON, and answers in several parts mended there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableweave.functions.scalars import without_cut_object

TRIES = 5
LITERAL = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)$"
# What a text may go on with: a value, a value or the end of a list, a key, a key or the end of an object, a colon, a comma or an end, nothing.
VALUE, FIRST, KEY, FIRST_KEY, COLON, COMMA, NOTHING = "v", "l", "k", "o", ":", ",", "e"
# A whole string, with at most so many escapes that the match needs no deep stack; and a number or word.
STRING = r'"[^"\\\x00-\x1F]*+(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})[^"\\\x00-\x1F]*+){0,50}+"'
WORD = r"(?<![0-9A-Za-z+.\-])(?:-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|true|false|null|NaN|-?Infinity)(?![0-9A-Za-z+.\-])"
# Lists and objects that hold no others, of strings \x01 and other values \x02; how deep they are looked for.
FLAT = r"\[(?:[\x01\x02](?:,[\x01\x02])*+)?+\]|\{(?:\x01:[\x01\x02](?:,\x01:[\x01\x02])*+)?+\}"
DEPTH = 5
_FIELDS = ("at", "want", "stack", "string", "escape", "begun", "literal", "fault")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with(s: Column, **new: Column | str | int | bool) -> Column:
    return F.struct(*[(new[f] if isinstance(new.get(f), Column) else F.lit(new[f]) if f in new else s[f]).alias(f) for f in _FIELDS])


def _ended(stack: Column) -> Column:
    """What may follow a value."""
    return F.when(stack == "", NOTHING).otherwise(COMMA)


def _popped(s: Column) -> Column:
    rest = F.substring(s["stack"], F.lit(1), F.char_length(s["stack"]) - 1)
    return _with(s, stack=rest, want=_ended(rest))


def _in_string(s: Column, c: Column) -> Column:
    key = s["want"].isin(KEY, FIRST_KEY)
    closed = _with(s, string=False, want=F.when(key, COLON).otherwise(_ended(s["stack"])))
    return (
        F.when((s["escape"] == 1) & (c == "u"), _with(s, escape=5))
        .when(s["escape"] == 1, F.when(c.isin(*'"\\/bfnrt'), _with(s, escape=0)).otherwise(_with(s, fault=s["at"] - 1)))
        .when(s["escape"] > 1, F.when(c.rlike("[0-9A-Fa-f]"), _with(s, escape=F.when(s["escape"] == 2, 0).otherwise(s["escape"] - 1))).otherwise(_with(s, fault=s["at"])))
        .when(c == "\\", _with(s, escape=1))
        .when(c == '"', closed)
        .when(c < " ", _with(s, fault=s["at"]))
        .otherwise(s)
    )


def _literal_ended(s: Column) -> Column:
    return F.when(s["literal"].rlike(LITERAL), _with(s, literal="", want=_ended(s["stack"]))).otherwise(_with(s, literal="", fault=s["begun"]))


def _structural(s: Column, c: Column) -> Column:
    top, fault = F.right(s["stack"], F.lit(1)), _with(s, fault=s["at"])
    quoted = _with(s, string=True, begun=s["at"])
    value = (
        F.when(c == '"', quoted)
        .when(c == "[", _with(s, stack=F.concat(s["stack"], F.lit("[")), want=FIRST))
        .when(c == "{", _with(s, stack=F.concat(s["stack"], F.lit("{")), want=FIRST_KEY))
        .when((c == "]") & (s["want"] == FIRST), _popped(s))
        .when(c.rlike("[-0-9tfnNI]"), _with(s, literal=c, begun=s["at"]))
        .otherwise(fault)
    )
    closes = ((c == "]") & (top == "[")) | ((c == "}") & (top == "{"))
    return (
        F.when((s["fault"] >= 0) | c.isin(" ", "\t", "\n", "\r"), s)
        .when(s["want"].isin(VALUE, FIRST), value)
        .when(s["want"].isin(KEY, FIRST_KEY), F.when(c == '"', quoted).when((c == "}") & (s["want"] == FIRST_KEY), _popped(s)).otherwise(fault))
        .when(s["want"] == COLON, F.when(c == ":", _with(s, want=VALUE)).otherwise(fault))
        .when(s["want"] == COMMA, F.when(c == ",", _with(s, want=F.when(top == "[", VALUE).otherwise(KEY))).when(closes, _popped(s)).otherwise(fault))
        .otherwise(fault)
    )


def surely_whole(text: Column) -> Column:
    """Whether ``text`` is seen to be JSON by patterns alone: strings, then words, then what is nested become one character each,
    inside out. False says nothing: a text may be nested deeper, or have a string with more escapes."""
    told = F.regexp_replace(F.regexp_replace(text, STRING, "\x01"), WORD, "\x02")
    told = F.regexp_replace(told, r"[ \t\n\r]++", "")
    for _ in range(DEPTH):
        told = F.regexp_replace(told, FLAT, "\x02")
    return ~text.rlike(r"[\x01\x02]") & told.isin("\x01", "\x02")


def first_fault(text: Column) -> Column:
    """The place from 0 of the character at which ``text`` stops being JSON, null if it is JSON.

    A string that isn't closed is at fault where it begins, as is a word that is no value; a text that ends too early at its
    end. A fold over the characters with what is open, so time grows with the text alone; most texts without a fault are told
    without it (``surely_whole``).
    """

    def step(s: Column, c: Column) -> Column:
        goes_on = (s["literal"] != "") & c.rlike(r"[0-9A-Za-z+.\-]")
        outside = F.when(goes_on, _with(s, literal=F.concat(s["literal"], c))).otherwise(_once(F.when(s["literal"] != "", _literal_ended(s)).otherwise(s), lambda t: _structural(t, c)))
        told = F.when(s["fault"] >= 0, s).when(s["string"], _in_string(s, c)).otherwise(outside)
        return _once(told, lambda t: _with(t, at=t["at"] + 1))

    start = F.struct(F.lit(0).alias("at"), F.lit(VALUE).alias("want"), F.lit("").alias("stack"), F.lit(False).alias("string"), F.lit(0).alias("escape"), F.lit(0).alias("begun"), F.lit("").alias("literal"), F.lit(-1).alias("fault"))

    def end(s: Column) -> Column:
        whole = F.when(s["literal"] != "", _literal_ended(s)).otherwise(s)
        return _once(whole, lambda t: F.when(t["fault"] >= 0, t["fault"]).when(t["string"], t["begun"]).when(t["want"] != NOTHING, t["at"]))

    # an empty text has no characters at all
    return F.when(text == "", F.lit(0)).when(~surely_whole(text), _once(F.aggregate(F.split(text, ""), start, step), end))


def stripped_parts(parts: Column) -> Column:
    """Parts without code fences; missing ones are left out."""
    plain = lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"^```json\s*", ""), "```$", "")
    return F.transform(F.filter(parts, lambda p: p.isNotNull()), plain)


def _state(parts: Column, text: Column, cut: Column, done: Column | None = None) -> Column:
    return F.struct(parts.alias("parts"), text.alias("text"), cut.alias("truncated"), (F.lit(False) if done is None else done).alias("done"))


def _begun_anew(parts: Column) -> Column:
    """Parts that begin a list anew go on in the one before, which ends at its last whole object; whether the last such end cut anything."""
    anew = lambda k: F.coalesce(F.get(parts, k).startswith("[{"), F.lit(False)) & (k > 0)
    own = lambda p, k: F.when(anew(k), F.substring(p, F.lit(2), F.char_length(p))).otherwise(p)
    # a part that has lost its bracket is cut as such by the part behind it
    told = F.transform(parts, lambda p, k: F.when(anew(k + 1), without_cut_object(own(p, k))).otherwise(own(p, k)))
    cuts = F.transform(parts, lambda p, k: F.when(anew(k + 1), without_cut_object(own(p, k)) != own(p, k)))
    cut = F.coalesce(F.get(F.reverse(F.filter(cuts, lambda c: c.isNotNull())), F.lit(0)), F.lit(False))
    return _state(told, F.array_join(told, ""), cut)


def _mended(s: Column, fault: Column) -> Column:
    """One repair: a single part is closed after its last whole object; of several, the part with the fault begins at its
    first object and the one before ends at its last whole one. The fault's column counts in its line."""
    before = F.substring(s["text"], F.lit(1), fault)
    column = F.char_length(F.substring_index(before, "\n", -1)) + 1
    alone = F.regexp_replace(F.trim(without_cut_object(F.get(s["parts"], F.lit(0)))), ",$", "")
    closed = _state(s["parts"], F.when(alone.endswith("]"), alone).otherwise(F.concat(alone, F.lit("]"))), without_cut_object(F.get(s["parts"], F.lit(0))) != F.get(s["parts"], F.lit(0)))
    until = lambda k: F.aggregate(F.slice(s["parts"], F.lit(1), k + 1), F.lit(0), lambda n, p: n + F.char_length(p))
    there = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s["parts"]) - 2, F.lit(0))), lambda k: (column >= until(k)) & (column < until(k + 1)))

    def at(found: Column) -> Column:
        k = F.get(found, F.lit(0))
        last, following = without_cut_object(F.get(s["parts"], k)), F.get(s["parts"], k + 1)
        brace = F.locate("{", following)
        rest = F.when(brace > 0, F.substring(following, brace, F.char_length(following))).otherwise(F.right(following, F.lit(1)))
        shown = F.when((brace == 0) & last.endswith(","), F.substring(last, F.lit(1), F.char_length(last) - 1)).otherwise(last)
        parts = F.transform(s["parts"], lambda p, n: F.when(n == k, shown).when(n == k + 1, rest).otherwise(p))
        return F.when(k.isNull(), s).otherwise(_once(parts, lambda x: _state(x, F.array_join(x, ""), F.lit(True))))

    return F.when(F.size(s["parts"]) == 1, closed).otherwise(_once(there, at))


def repaired_answers(parts: Column) -> Column:
    """``text, truncated`` of an answer that came in several parts (an array): one JSON text, if at most five repairs where
    it stops being JSON make it one, and whether something was cut. No parts at all are an empty text."""

    def attempt(s: Column, _: Column) -> Column:
        # once a text is JSON it isn't looked at again
        whole = _state(s["parts"], s["text"], s["truncated"], F.lit(True))
        told = _once(first_fault(s["text"]), lambda fault: F.when(fault.isNull() | (F.size(s["parts"]) == 0), whole).otherwise(_mended(s, fault)))
        return F.when(s["done"], s).otherwise(told)

    begun = _once(stripped_parts(parts), _begun_anew)
    told = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), begun, attempt)
    return _once(told, lambda s: F.struct(s["text"].alias("text"), s["truncated"].alias("truncated")))
