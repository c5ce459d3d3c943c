"""Sections of a document, and what is wrong with their shape. All of it runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import FLAGS as FLAGS_SAY
from .text import stripped

#: What ends a line.
BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
_OPENS = rf"(?U)[[\s\x1c-\x1f]&&[^{BREAKS}]]*###? "


def body(text: Column) -> Column:
    """The text behind its frontmatter, if that is closed."""
    end = F.locate("\n---\n", text, 5)
    return F.when(F.startswith(text, F.lit("---\n")) & (end > 0), F.substring(text, end + 5, F.length(text))).otherwise(text)


def header(text: Column) -> Column:
    """The frontmatter's lines, null if there is none."""
    end = F.locate("\n---\n", text, 5)
    return F.when(F.startswith(text, F.lit("---\n")) & (end > 0), F.substring(text, F.lit(5), end - 5))


def sections(text: Column) -> Column:
    """The text cut in front of each H2 or H3 line; what stands before the first counts unless it is blank."""
    parts = F.split(text, rf"(?:(?<=[{BREAKS}])|^)(?={_OPENS})")
    return F.filter(parts, lambda x: x.rlike("^" + _OPENS) | (stripped(x) != ""))


def has_title(text: Column) -> Column:
    return text.rlike(rf"(?:^|[{BREAKS}])# ")


def _has_content(part: Column) -> Column:
    """True if more than frontmatter, H1 lines and blank lines stand there."""
    return F.exists(F.split(body(part), f"[{BREAKS}]"), lambda x: (stripped(x) != "") & ~F.startswith(stripped(x), F.lit("# ")))


def flags(text: Column, max_tokens: int = 850, max_chars: int = 3600) -> Column:
    """Flags (rule, section, detail) of all sections, in order; none if the text is well cut."""

    def of(part: Column, i: Column) -> Column:
        opened = part.rlike("^" + _OPENS)
        label = F.when(opened, stripped(F.regexp_extract(part, f"^[^{BREAKS}]*", 0))).otherwise(F.concat(F.lit("<section #"), i.cast("string"), F.lit(" (no heading)>")))
        size = F.length(part)
        tokens = F.floor(size / 4)
        flag = lambda rule, when, detail: F.when(when, F.struct(F.lit(rule).alias("rule"), label.alias("section"), detail.alias("detail")))
        return F.array(
            flag("missing_leading_heading", ~opened & _has_content(part), F.lit(FLAGS_SAY["missing_leading_heading"])),
            flag("over_est_tokens", tokens > max_tokens, F.concat(tokens.cast("string"), F.lit(f"{FLAGS_SAY['over_est_tokens']}{max_tokens}"))),
            flag("over_chars", size > max_chars, F.concat(size.cast("string"), F.lit(f"{FLAGS_SAY['over_chars']}{max_chars}"))),
        )

    return F.filter(F.flatten(F.transform(sections(text), of)), lambda x: x.isNotNull())


def ledger(text: Column) -> Column:
    """What stands under an H2 or deeper "stripping ledger" heading, up to the next H1 or H2."""
    return F.regexp_extract(text, r"(?imsdU)^##+[\s\x1c-\x1f]*stripping ledger[\s\x1c-\x1f]*$\n(.*?)(?=^#{1,2}[\s\x1c-\x1f]|\z)", 1)
