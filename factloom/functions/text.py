"""Tokens, names, labels, literals and ids as column expressions (F-10 to F-21, F-25, F-32, P-15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import fold, strip

# Action words of keys in their order, suffixes that no plural s follows, leaf and operational keys.
ACTIONS = ["authenticate", "authorize", "register", "configure", "confirm", "download", "upload", "remove", "adjust", "create", "update", "delete", "reset", "password", "recover", "search", "getall", "list", "index", "show", "edit", "start", "stop", "add", "get", "set"]
NO_PLURAL = ["ss", "us", "is", "as", "os"]
OPERATIONAL = ["health", "summary", "runtime", "metrics", "monitor", "readiness", "ready", "ping", "status", "utils", "install"]


def tokens(text: Column, least: int = 3, generic: list[str] | None = None) -> Column:
    """Lower-case identifier tokens: split at case changes and at what is no letter or digit (F-10)."""
    split = F.regexp_replace(text, r"(?<=[\p{Ll}0-9])(?=\p{Lu})", " ")
    parts = F.split(fold(F.regexp_replace(split, r"[^\p{L}\p{N}]+", " ")), " ")
    kept = F.filter(parts, lambda t: F.octet_length(t) >= least)
    return F.filter(kept, lambda t: ~t.isin(generic)) if generic else kept


def compact_key(key: Column) -> Column:
    return fold(F.regexp_replace(key, r"[-_/]", ""))


def key_action(key: Column) -> Column:
    """The first action word, in list order, that a compact key starts with and doesn't end at (F-11)."""
    compact = compact_key(key)
    return F.coalesce(*[F.when(F.startswith(compact, F.lit(a)) & (F.length(compact) > len(a)), F.lit(a)) for a in ACTIONS])


def key_entity(key: Column) -> Column:
    """What the action word leaves of a compact key; all of it without one."""
    compact, action = compact_key(key), key_action(key)
    return F.nullif(F.when(action.isNull(), compact).otherwise(F.substring(compact, F.length(action) + 1, F.length(compact))), F.lit(""))


def share_entity(a: Column, b: Column) -> Column:
    """Entities are equal, or one holds the other (F-13)."""
    x, y = key_entity(a), key_entity(b)
    return F.coalesce(F.contains(x, y) | F.contains(y, x), F.lit(False))


def token_window(text: Column, pattern: Column) -> Column:
    """The tokens of `pattern` stand in `text` one after the other (F-12)."""
    line = lambda c: F.concat(F.lit(" "), F.array_join(tokens(c, 1), " "), F.lit(" "))
    return F.contains(line(text), line(pattern))


def snake_case(name: Column) -> Column:
    """PascalCase to snake_case, acronyms kept whole (F-14)."""
    return fold(F.regexp_replace(F.regexp_replace(name, r"(?<=[a-z])(?=[A-Z])", "_"), r"(?<=[^_])(?=[A-Z][a-z])", "_"))


def singular_variants(token: Column) -> Column:
    """The token and its safe singulars (F-16)."""
    n = F.octet_length(token)
    ends = lambda s: F.endswith(token, F.lit(s))
    plain = ends("s")
    for s in NO_PLURAL:
        plain = plain & ~ends(s)
    head = lambda k: F.substring(token, F.lit(1), F.length(token) - k)
    return F.array_compact(
        F.array(
            token,
            F.when((n > 4) & ends("ies"), F.concat(head(3), F.lit("y"))),
            F.when((n > 3) & plain, head(1)),
            F.when((n > 4) & ends("es"), head(2)),
        )
    )


def key_variants(key: Column) -> Column:
    """All combinations of the tokens' singular variants, joined by `::` (F-16)."""
    parts = F.filter(F.split(fold(key), "[^A-Za-z0-9]+"), lambda t: t != "")
    grow = lambda done, token: F.flatten(F.transform(done, lambda d: F.transform(singular_variants(token), lambda v: F.when(d == "", v).otherwise(F.concat(d, F.lit("::"), v)))))
    return F.array_distinct(F.aggregate(parts, F.array(F.lit("")), grow))


def keys_equivalent(a: Column, b: Column) -> Column:
    return F.arrays_overlap(key_variants(a), key_variants(b))


def label(key: Column) -> Column:
    """A display name: two abbreviations by hand, else each word with a capital (F-17)."""
    words = F.filter(F.split(key, r"\s+"), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return F.when(fold(key) == "ws", "WebSocket").when(fold(key) == "stt", "STT").otherwise(title)


def operational_key(key: Column) -> Column:
    """Technical and operational keys, page files excepted (P-10)."""
    page = F.endswith(key, F.lit(".html")) | F.endswith(key, F.lit(".htm"))
    technical = ~page & (F.startswith(key, F.lit("test")) | F.contains(key, F.lit("debug")) | key.isin("health", "summary"))
    return technical | key.isin(OPERATIONAL[2:])


def last_segment(name: Column) -> Column:
    """What follows the last `.`, else `::`, else `->` (F-18)."""
    return (
        F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))
        .when(F.contains(name, F.lit("::")), F.substring_index(name, "::", -1))
        .otherwise(F.substring_index(name, "->", -1))
    )


def short_name(name: Column) -> Column:
    """The last two `::` parts (F-32)."""
    return F.substring_index(name, "::", -2)


def relative_target(target: Column, module: Column) -> Column:
    """A target with leading dots against its module's path; one part goes for each dot (F-19)."""
    dots = F.length(F.regexp_extract(target, r"^(\.*)", 1))
    parts = F.split(module, "::")
    kept = F.slice(parts, 1, F.greatest(F.size(parts) - dots, F.lit(0)))
    rest = F.regexp_replace(F.regexp_replace(target, r"^\.+", ""), r"\.", "::")
    return F.when(dots == 0, target).otherwise(F.array_join(F.array_append(kept, F.nullif(rest, F.lit(""))), "::"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 24 hex digits of the SHA-256 of the parts, a NUL after each but the last (F-25)."""
    text = F.concat_ws("\0", *parts)
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 24))


def valid_text(text: Column, most: int) -> Column:
    """Not blank, one line, at most so many characters (P-15)."""
    return F.coalesce((F.length(strip(text)) >= 1) & (F.length(text) <= most) & ~text.rlike(r"[\r\n]"), F.lit(False))


def string_literal(text: Column) -> Column:
    """What a quoted literal holds; `${...}` of a template becomes `:param`; null if it is none (F-21)."""
    inner = F.regexp_extract(strip(text), r"""^(['"`])(.*)\1$""", 2)
    quoted = strip(text).rlike(r"""^(['"`]).*\1$""")
    return F.when(quoted, F.regexp_replace(inner, r"\$\{[^}]*\}", ":param"))


def one_line(parts: list[Column], most: int = 160) -> Column:
    """Parts joined by a middle dot, cut at `most` characters with an ellipsis (P-23)."""
    text = F.concat_ws(" · ", *parts)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def split_arguments(text: str, brackets: str = "()[]{}", quotes: str = "\"'`", escape: str = "\\") -> list[str]:
    """Top-level comma parts of an argument list: brackets nest, quoted text is kept whole (F-20)."""
    close = dict(zip(brackets[::2], brackets[1::2]))
    out, depth, quote, part, i = [], [], "", [], 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == escape and i + 1 < len(text):
                part.append(c)
                i += 1
                c = text[i]
            elif c == quote:
                quote = ""
        elif c in quotes:
            quote = c
        elif c in close:
            depth.append(close[c])
        elif depth and c == depth[-1]:
            depth.pop()
        elif c == "," and not depth:
            out.append("".join(part).strip())
            part = []
            i += 1
            continue
        part.append(c)
        i += 1
    last = "".join(part).strip()
    return [*out, last] if last or out else []
