"""Text expressions: cleaning, splitting, classification, validation. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as Python's str.strip and \s see it, for Java patterns.
SPACE = r"[\s\x{85}\x{a0}\x{b}\x{1c}-\x{1f}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: Column) -> Column:
    """Text without outer whitespace of any kind; null stays null."""
    return F.regexp_replace(F.regexp_replace(x, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def clean(x: Column) -> Column:
    """Whitespace runs become a space, all but ASCII letters, digits and ``.,;:!?()-`` spaces; null and blank give ''."""
    spaced = F.regexp_replace(F.coalesce(x, F.lit("")), f"{SPACE}+", " ")
    kept = F.regexp_replace(spaced, r"[^a-zA-Z0-9 .,;:!?()\-]", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def clean_legacy(x: Column) -> Column:
    """The older cleaning: only written-out ``\\s`` runs count as whitespace, and backslashes stay."""
    first = F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"\\s+", " ")
    kept = F.regexp_replace(first, r"[^a-zA-Z0-9\\s.,;:!?()\-]", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def keyword_lines(x: Column, keywords: list[str], least: int = 20) -> Column:
    """Stripped lines of more than ``least`` characters that hold a keyword in any case."""
    lines = F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), strip)
    return F.filter(lines, lambda p: (F.length(p) > least) & F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(p), k)))


def content_type_of(path: Column) -> Column:
    """Type of a page by its path; the first rule that fits counts."""
    p = F.lower(path)
    return (
        F.when(F.contains(p, F.lit("admission")), "admission")
        .when(F.contains(p, F.lit("course")) | F.contains(p, F.lit("academic")), "courses")
        .when(F.contains(p, F.lit("about")), "about")
        .when(F.contains(p, F.lit("facilit")), "facilities")
        .otherwise("general")
    )


def token_estimate(x: Column) -> Column:
    """Words times 1.3, rounded down."""
    words = F.filter(F.split(F.coalesce(x, F.lit("")), f"{SPACE}+"), lambda w: w != "")
    return F.floor(F.size(words) * F.lit(1.3)).cast("bigint")


def or_default(x: Column, default: str) -> Column:
    """The default for null and ''."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def username_issue(name: Column) -> Column:
    """The first rule a user name breaks, null for a good one (and for null)."""
    return (
        F.when(F.length(name) < 3, "too_short")
        .when(F.length(name) > 30, "too_long")
        .when(~name.rlike(r"\A[a-zA-Z0-9_.\-]+\z"), "bad_characters")
        .when(F.startswith(name, F.lit(".")) | F.endswith(name, F.lit(".")), "outer_dot")
    )


#: Passwords too common to be accepted.
COMMON_PASSWORDS = ("password", "123456", "qwerty", "abc123", "password123")


def password_issues(p: Column) -> Column:
    """All rules a password breaks, in fixed order."""
    tests = [
        (F.length(p) < 8, "length"),
        (~p.rlike("[A-Z]"), "uppercase"),
        (~p.rlike("[a-z]"), "lowercase"),
        (~p.rlike(r"[0-9]"), "digit"),
        (~p.rlike(r'[!@#$%^&*(),.?":{}|<>]'), "special"),
        (F.lower(p).isin(*COMMON_PASSWORDS), "common"),
    ]
    return F.array_compact(F.array(*[F.when(bad, name) for bad, name in tests]))


def email_normalised(x: Column) -> Column:
    """An address of plausible form with its domain in lower case, else null."""
    ok = x.rlike(r"\A[A-Za-z0-9.!#$%&'*+/=?^_`{|}~\-]+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+\z") & ~x.rlike(r"\A\.|\.@|\.\.")
    return F.when(ok, F.concat(F.substring_index(x, "@", 1), F.lit("@"), F.lower(F.substring_index(x, "@", -1))))


def daytime(ts: Column) -> Column:
    """morning before 12, afternoon before 17, else evening."""
    h = F.hour(ts)
    return F.when(h < 12, "morning").when(h < 17, "afternoon").otherwise("evening")


def stripped_of(x: Column, signs: str) -> Column:
    """Text without the given signs at both ends."""
    return F.btrim(x, F.lit(signs))


def grouped(x: Column, decimals: int = 0) -> Column:
    """A number with thousands separators."""
    return F.format_number(x, decimals)


def percent_text(x: Column, signed: bool = False) -> Column:
    """A number with one decimal and a percent sign, with its own sign if wanted."""
    return F.format_string("%+.1f%%" if signed else "%.1f%%", x)


def resolved(base: Column, path: Column) -> Column:
    """A path against an address: whole addresses stay, //host paths take the scheme, /paths the host, others the base's folder."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+(?:/(?:[^/?#]*/)*)?)", 1)
    return (
        F.when(path.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), path)
        .when(F.startswith(path, F.lit("//")), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), path))
        .when(F.startswith(path, F.lit("/")), F.concat(root, path))
        .when(path == "", base)
        .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), path))
    )


def first_long(candidates: list[Column], least: int, drop_below: int) -> Column:
    """The first candidate of at least ``least`` characters, else the last one; null where that has under ``drop_below``."""
    chosen = F.coalesce(*[F.when(F.length(c) >= least, c) for c in candidates[:-1]], candidates[-1])
    return F.when(F.length(chosen) >= drop_below, chosen)


def money(x: Column) -> Column:
    """Amount of a text with currency sign and digit grouping, as a whole number; null without digits."""
    return F.nullif(F.regexp_replace(x, "[^0-9]", ""), F.lit("")).cast("bigint")


def percentage(x: Column) -> Column:
    """The first percentage of a text, null if there is none."""
    return F.nullif(F.regexp_extract(x, r"(\d+)%", 1), F.lit("")).cast("bigint")


def command_of(x: Column) -> Column:
    """What a chat line asks for: leave, a command, an unknown command, or a question."""
    c = strip(F.lower(x))
    return (
        F.when(c.isin("exit", "quit", "bye"), "leave")
        .when(c.isin("/status", "/models", "/stats", "/clear", "/profile", "/help"), F.substring(c, 2, 20))
        .when(F.startswith(c, F.lit("/")), "unknown")
        .when(c == "", "nothing")
        .otherwise("question")
    )


def prompt(question: Column, context: Column, history: Column, system: str) -> Column:
    """System text, then context and history if there are any, then the question."""
    part = lambda head, x: F.when(F.nullif(x, F.lit("")).isNotNull(), F.concat(F.lit(head), x))
    return F.concat_ws("\n", F.lit(system), part("\n\nRelevant Information:\n", context), part("\n\nConversation History:\n", history), F.concat(F.lit("\n\nUser Question: "), question), F.lit("\n\nAssistant:"))


def generated_text(j: Column) -> Column:
    """The text of a model's JSON answer: a list's first item, an object's field, else the text itself."""
    return F.coalesce(F.get_json_object(j, "$[0].generated_text"), F.get_json_object(j, "$.generated_text"), j)
