"""Column functions over names, paths and texts. All run inside the JVM."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as v

#: White space as Python's str methods see it, for Java patterns.
SPACE = r"(?U)[\s\x1c-\x1f]"
PREFIXES = ("claude-", "chatgpt-")
LEVELS = ("public", "internal", "private", "proprietary")
#: What stands in front of a path on a drive, and on a drive that is mounted; a separator follows.
DRIVE, MOUNT = r"^([A-Za-z]):(?=[\\/])", r"^/(?:mnt/)?([A-Za-z])(?=/)"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def sha(text: Column) -> Column:
    """SHA-256 of bytes, or of a text's UTF-8 form, in upper-case hex."""
    return F.upper(F.sha2(text, 256))


def decoded(content: Column) -> Column:
    """Bytes as text: malformed UTF-8 becomes U+FFFD and every line break a line feed."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def collapsed(text: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _first(conditions: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    out = otherwise
    for condition, value in reversed(conditions):
        out = F.when(condition, value).otherwise(out)
    return out


def without_prefix(stem: Column, prefixes: Sequence[str]) -> Column:
    """``stem`` without the first of ``prefixes`` that it begins with."""
    return _first([(F.startswith(stem, F.lit(p)), F.substring(stem, F.lit(len(p) + 1), F.length(stem))) for p in prefixes], stem)


def before_last_dot(name: Column) -> Column:
    """The name up to its last full stop; the whole name if that leaves nothing or there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(?s)^(.*)\.[^.]*\z", 1), F.lit("")), name)


def stem(name: Column) -> Column:
    """A file name without its extension; leading full stops begin no extension."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(?s)^(\.*[^.].*)\.[^.]*\z", 1), F.lit("")), name)


def extension(name: Column) -> Column:
    return F.substring(name, F.length(stem(name)) + 1, F.length(name))


def title(name: Column, prefixes: Sequence[str] = PREFIXES) -> Column:
    """The bucket key of a file name: no extension, no trailing (N), no leading x, no export prefix; letters a-z and digits only."""
    t = F.lower(F.regexp_replace(before_last_dot(name), r"(?U)[\s\x1c-\x1f]*\(\d+\)$", ""))
    t = F.when(F.startswith(t, F.lit("x")) & (F.length(t) > 1), F.substring(t, F.lit(2), F.length(t))).otherwise(t)
    return F.trim(F.regexp_replace(without_prefix(t, prefixes), "[^a-z0-9]+", " "))


def is_generic(name: Column, stems: Sequence[str] = v.GENERIC_STEMS) -> Column:
    return F.lower(before_last_dot(name)).isin(list(stems))


def slug(path: Column, prefixes: Sequence[str] = PREFIXES) -> Column:
    s = without_prefix(F.lower(stem(base_name(path))), prefixes)
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def artifact_name(path: Column) -> Column:
    """The base name; names that say nothing get the folder's in front."""
    base = base_name(path)
    return F.when(base.isin(list(v.GENERIC_BASENAMES)), F.concat(base_name(directory(path)), F.lit("__"), base)).otherwise(base)


def artifact_id(name: Column, prefix: str = "KB-") -> Column:
    return F.concat(F.lit(prefix), F.left(F.replace(F.lower(name), F.lit(" "), F.lit("-")), F.lit(60)))


_NUMBERED = r"^(.+?) \((\d+)\)(\.[^.]+)$"


def is_numbered(name: Column) -> Column:
    """True for ``name (N).ext``."""
    return name.rlike(_NUMBERED)


def unnumbered(name: Column) -> Column:
    """``name.ext`` of ``name (N).ext``, null of any other name."""
    return F.when(is_numbered(name), F.regexp_replace(name, _NUMBERED, "$1$3"))


def number(name: Column) -> Column:
    return F.when(is_numbered(name), F.regexp_extract(name, _NUMBERED, 2).cast("int"))


def excluded(relative: Column, globs: Sequence[str]) -> Column:
    """True if a path below a root matches a glob; a leading ``**/`` may also stand for nothing, and * crosses /."""
    wanted = [w for g in globs for w in ((g, g[3:]) if g.startswith("**/") else (g,))]
    if not wanted:
        return F.lit(False)
    return F.lit(False) | relative.rlike("|".join(f"(?:^(?s:{_java(w)})\\z)" for w in wanted))


def _java(glob: str) -> str:
    """A shell pattern as a Java one."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            inside = glob[i:end].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[{'^' + inside[1:] if inside.startswith('!') else inside}]"
            i = end + 1
        else:
            out += re.escape(c)
    return out


def matches(name: str, globs: Sequence[str]) -> bool:
    """``excluded`` for one path, on the driver."""
    return any(fnmatch.fnmatch(name, w) for g in globs for w in ((g, g[3:]) if g.startswith("**/") else (g,)))


def repaired(text: Column) -> Column:
    """Undoes UTF-8 that was read as Latin-1, for the characters that matter; once repaired, a text stays as it is."""
    for wrong, right in v.MOJIBAKE:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """``table[key]``, null if it isn't there."""
    return _first([(key == k, F.lit(x)) for k, x in table.items()], F.lit(None).cast("string"))


def status(raw: Column, valid: Sequence[str] = v.STATUSES, synonyms: Mapping[str, str] = v.STATUS_MAP, default: str = "seeded") -> Column:
    s = F.lower(stripped(F.coalesce(raw, F.lit(""))))
    return F.coalesce(F.when(s.isin(list(valid)), s), lookup(s, synonyms), F.lit(default))


def conventional_id(id_: Column, fallback: Column, prefix: str = "KB-") -> Column:
    has = F.coalesce(id_ != "", F.lit(False))
    return F.when(has & F.startswith(id_, F.lit(prefix)), id_).otherwise(F.concat(F.lit(prefix), F.lower(F.when(has, id_).otherwise(fallback))))


def domain(type_: Column, domains: Mapping[str, str] = v.DOMAINS, default: str = "reference") -> Column:
    return F.coalesce(lookup(F.lower(F.coalesce(type_, F.lit(""))), domains), F.lit(default))


def level(value: Column, unset: str = "internal", unknown: str = "proprietary") -> Column:
    """An admissibility level: a missing one counts as ``unset``, an unknown one as ``unknown``."""
    raw = F.lower(stripped(value))
    return F.when(value.isNull(), unset).when(raw.isin(list(LEVELS)), raw).otherwise(unknown)


def level_rank(value: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in LEVELS)), value).cast("int") - 1


def posix_path(path: Column) -> Column:
    """Drive paths as mounts: C:\\x becomes /mnt/c/x."""
    rest = F.replace(F.regexp_replace(path, DRIVE, ""), F.lit("\\"), F.lit("/"))
    return F.when(path.rlike(DRIVE), F.concat(F.lit("/mnt/"), F.lower(F.left(path, F.lit(1))), F.lit("/"), F.ltrim(rest, F.lit("/")))).otherwise(rest)


def windows_path(path: Column) -> Column:
    """Mounts, also short ones, as drive paths: /mnt/c/x and /c/x become C:\\x."""
    drive = F.when(path.rlike(DRIVE), F.regexp_extract(path, DRIVE, 1)).when(path.rlike(MOUNT), F.regexp_extract(path, MOUNT, 1))
    rest = F.replace(F.when(path.rlike(DRIVE), F.regexp_replace(path, DRIVE, "")).otherwise(F.regexp_replace(path, MOUNT, "")), F.lit("/"), F.lit("\\"))
    return F.concat(F.coalesce(F.concat(F.upper(drive), F.lit(":")), F.lit("")), rest)


def local_path(path: Column) -> Column:
    """As the executors' (POSIX) hosts resolve it."""
    return F.when(path.rlike(DRIVE), posix_path(path)).otherwise(path)


def stored_path(path: Column, style: str = "native") -> Column:
    return _styled(style, {"native": lambda p: p, "posix": posix_path, "windows": windows_path})(path)


def stored(path: str, style: str = "native") -> str:
    """``stored_path`` for one path, on the driver, where a native path is made absolute."""

    def posix(p: str) -> str:
        drive = re.match(DRIVE, p)
        rest = p[drive.end() if drive else 0 :].replace("\\", "/")
        return f"/mnt/{drive[1].lower()}/{rest.lstrip('/')}" if drive else rest

    def windows(p: str) -> str:
        drive = re.match(DRIVE, p) or re.match(MOUNT, p)
        return (f"{drive[1].upper()}:" if drive else "") + p[drive.end() if drive else 0 :].replace("/", "\\")

    return _styled(style, {"native": lambda p: p if os.path.isabs(p) else os.path.abspath(p), "posix": posix, "windows": windows})(path)


def _styled(style: str, ways: Mapping):
    if style not in ways:
        raise ValueError(f"no such path style: {style!r}")
    return ways[style]


def tier(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The tier of the first rule whose fragment is in the path, whatever the case; 'live' if none is."""
    low = F.lower(posix_path(path))
    return _first([(F.contains(low, F.lower(posix_path(F.lit(r)))), F.lit(t)) for r, t in rules if r], F.lit("live"))


def under(path: Column, root: str) -> Column:
    return (path == root) | F.startswith(path, F.lit(root.rstrip("/") + "/"))


def root_rank(path: Column, roots: Sequence[str]) -> Column:
    """Place of the first root that holds the path; as many as there are roots if none does."""
    return _first([(under(path, r), F.lit(i)) for i, r in enumerate(roots)], F.lit(len(roots)))


def safe_name(value: Column, limit: int = 64) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", ""), F.lit(limit))


def without_query(path: Column) -> Column:
    return F.substring_index(path, "?", 1)
