"""What a scan takes in: exclusions, links, placeholders, read states, nesting of roots."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attribute bits, the tag bit of links, and what every scan skips.
DIRECTORY, REPARSE = 0x10, 0x400
OFFLINE, RECALL_ON_OPEN, RECALL_ON_DATA_ACCESS = 0x1000, 0x40000, 0x400000
NAME_SURROGATE = 0x20000000
FILETIME_EPOCH = 116_444_736_000_000_000
DEFAULT_NAMES = ["$RECYCLE.BIN", "System Volume Information", "pagefile.sys", "hiberfil.sys", "swapfile.sys", "DumpStack.log*", "*.tmp", "~$*", ".Trash-*", ".Spotlight-V100", "$WinREAgent", "Config.Msi"]
DEFAULT_PREFIXES = [r"C:\Windows", r"C:\Program Files", r"C:\Program Files (x86)", r"C:\ProgramData\Package Cache", r"C:\$WinREAgent", r"?:\Users\*\AppData\Local\Temp"]


def glob_regex(pattern: str) -> str:
    """A shell pattern (``*``, ``?``, ``[seq]``, ``[!seq]``) as a regular expression for lower-cased text."""
    out, i, p = "", 0, pattern.lower()
    while i < len(p):
        c = p[i]
        end = p.find("]", i + 2 if p[i + 1 : i + 2] != "!" else i + 3) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = p[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def excluded_name(name: Column, patterns: list[str]) -> Column:
    return _any([F.lower(name).rlike(glob_regex(p)) for p in patterns])


def excluded_path(relative: Column, patterns: list[str]) -> Column:
    """Patterns with a separator match the path below the root."""
    tidy = F.lower(F.replace(relative, F.lit("\\"), F.lit("/")))
    return _any([tidy.rlike(glob_regex(p.replace("\\", "/"))) for p in patterns])


def _components(path: str) -> list[str]:
    """Lower-case parts of a path between either kind of slash; slashes at the end don't count."""
    return re.split(r"[\\/]", re.sub(r"[\\/]+$", "", path.lower()))


def prefix_covers(prefix: str, path: str) -> bool:
    """Whether ``path`` is ``prefix`` or lies below it; wildcards stand within one component."""
    wanted = [re.compile(glob_regex(w)) for w in _components(prefix)]
    found = _components(path)[: len(wanted)]
    return len(found) == len(wanted) and all(w.match(p) for w, p in zip(wanted, found))


def excluded_prefix(absolute: Column, prefixes: list[str]) -> Column:
    """The path is a prefix or lies beneath one, by whole components."""
    parts = F.split(F.replace(F.regexp_replace(F.lower(absolute), r"[\\/]+$", ""), F.lit("/"), F.lit("\\")), r"\\")
    hits = []
    for prefix in prefixes:
        wanted = _components(prefix)
        hit = F.size(parts) >= len(wanted)
        for k, w in enumerate(wanted):
            hit = hit & F.coalesce(F.get(parts, F.lit(k)).rlike(glob_regex(w)), F.lit(False))
        hits.append(hit)
    return _any(hits)


def exclusion(user_patterns: list[str], root: str, defaults: bool = True, windows: bool = False):
    """A function of (name, relative path, absolute path) columns: whether a scan of ``root`` skips the entry.

    A default prefix that the root itself lies in is dropped: choosing the root was explicit.
    """
    names = (DEFAULT_NAMES if defaults else []) + [p for p in user_patterns if "/" not in p and "\\" not in p]
    paths = [p for p in user_patterns if "/" in p or "\\" in p]
    prefixes = [p for p in (DEFAULT_PREFIXES if defaults and windows else []) if not prefix_covers(p, root)]
    return lambda name, relative, absolute: excluded_name(name, names) | excluded_path(relative, paths) | excluded_prefix(absolute, prefixes)


def has_bit(attrs: Column, mask: int) -> Column:
    return F.coalesce(attrs.cast("long"), F.lit(0).cast("long")).bitwiseAND(F.lit(mask).cast("long")) != 0


def placeholder(attrs: Column) -> Column:
    """The bytes aren't there: opening the file would fetch them."""
    return has_bit(attrs, OFFLINE | RECALL_ON_OPEN | RECALL_ON_DATA_ACCESS)


def skip_as_link(attrs: Column, tag: Column, is_dir: Column) -> Column:
    """A reparse point that a scan doesn't follow: any directory, a file whose tag names another, an untagged file with its bytes."""
    tagged = F.coalesce(tag, F.lit(0)) != 0
    file = F.when(tagged, has_bit(tag, NAME_SURROGATE)).otherwise(~placeholder(attrs))
    return has_bit(attrs, REPARSE) & (is_dir | file)


def read_state(stat_failed: Column, attrs: Column) -> Column:
    return F.when(stat_failed, "unreadable").when(placeholder(attrs), "skipped-dehydrated").otherwise("ok")


def filetime_ns(filetime: Column) -> Column:
    """Nanoseconds since 1970; zero for times before it."""
    return F.when(filetime > FILETIME_EPOCH, (filetime - FILETIME_EPOCH) * 100).otherwise(F.lit(0).cast("long"))


def nests(roots: list[str], new: str) -> str | None:
    """The root that ``new`` lies in or around, or that it equals; None if it stands alone."""
    mine = _components(new)
    for root in roots:
        other = _components(root)
        k = min(len(mine), len(other))
        if mine[:k] == other[:k]:
            return root
    return None


def bind_roots(roots: DataFrame, catalogued: DataFrame, mounted: DataFrame) -> DataFrame:
    """``roots`` with ``bound``: whether the volume mounted at the root's mount point is the one on record.

    ``catalogued``: id, volume_guid. ``mounted``: mount, volume_guid. ``roots``: volume_id, mount.
    """
    known = catalogued.select(F.col("id").alias("volume_id"), F.col("volume_guid").alias("_want"))
    now = mounted.select("mount", F.col("volume_guid").alias("_have"))
    return roots.join(known, "volume_id", "left").join(now, "mount", "left").withColumn("bound", F.coalesce(F.col("_want") == F.col("_have"), F.lit(False))).drop("_want", "_have")
