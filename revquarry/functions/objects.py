"""Column functions on content, names and modes. All are built-in expressions; none runs Python on data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the object format.
TEXT_PROBE_BYTES = 8000
LFS_PREFIX = "version https://git-lfs.github.com/spec/v1"
MODE_KINDS = {"100644": "blob", "100755": "executable", "120000": "symlink", "40000": "tree", "160000": "gitlink"}
FNV_PRIME, FNV_OFFSET = 16777619, 2166136261


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def object_id(kind: str, data: Column | str) -> Column:
    """The content address: sha1 of "<kind> <length>", a NUL byte and the data."""
    raw = c(data).cast("binary")
    head = F.concat(F.lit(f"{kind} "), F.octet_length(raw).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), raw))


def is_text(data: Column | str) -> Column:
    """No NUL byte among the first 8,000 bytes."""
    return ~F.contains(F.substring(c(data).cast("binary"), 1, TEXT_PROBE_BYTES), F.unhex(F.lit("00")))


def is_hash(x: Column | str) -> Column:
    """40 or 64 hexadecimal digits in either case."""
    return c(x).rlike("^([0-9a-fA-F]{40}|[0-9a-fA-F]{64})$")


def is_lfs(text: Column | str) -> Column:
    return c(text).startswith(LFS_PREFIX)


def lfs_pointer(text: Column | str) -> Column:
    """``struct<sha256,size>`` of a pointer; null for other text; an error for a malformed pointer."""
    full = r"^version [^\n]*\noid sha256:([0-9a-f]{64})\nsize ([0-9]+)"
    found = F.struct(F.regexp_extract(c(text), full, 1).alias("sha256"), F.regexp_extract(c(text), full, 2).cast("long").alias("size"))
    return F.when(~is_lfs(text), F.lit(None)).when(c(text).rlike(full), found).otherwise(F.raise_error(F.lit("Invalid LFS pointer.")))


def mode_kind(mode: Column | str) -> Column:
    """The kind of an octal mode string; null when unknown."""
    out = F.lit(None).cast("string")
    for octal, kind in MODE_KINDS.items():
        out = F.when(c(mode) == octal, F.lit(kind)).otherwise(out)
    return out


def mode_number(mode: Column | str) -> Column:
    return F.conv(c(mode), 8, 10).cast("int")


def mode_octal(number: Column | str) -> Column:
    return F.conv(c(number).cast("string"), 10, 8)


_SIGNATURE = r"^([^<]*)<([^>]*)> (-?[0-9]+) ([+-])([0-9]{2})([0-9]{2})$"


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: a column's expression is else repeated."""
    return F.transform(F.array(value), use)[0]


def signature(text: Column | str, strict: bool = True) -> Column:
    """``struct<name,email,epoch,tz_min>`` of "name <email> epoch +hhmm"; null stays null.

    Malformed text is an error when ``strict``, else null.
    """

    def parsed(t: Column) -> Column:
        # One match gives all parts; no part but the name and the address can hold a line end, and a text with one doesn't match.
        parts = F.split(F.regexp_replace(t, _SIGNATURE, "$1\n$2\n$3\n$41\n$5\n$6"), "\n")
        number = lambda v, k: F.get(v, F.lit(k)).cast("int")
        found = _once(parts, lambda v: F.struct(F.trim(F.get(v, F.lit(0))).alias("name"), F.get(v, F.lit(1)).alias("email"), F.get(v, F.lit(2)).cast("long").alias("epoch"), (number(v, 3) * (number(v, 4) * 60 + number(v, 5))).alias("tz_min")))
        rest = F.lit(None)
        if strict:
            no_zone = t.rlike(r"^[^<]*<[^>]*> -?[0-9]+ ")
            rest = F.when(no_zone, F.raise_error(F.lit("Invalid time zone offset format."))).otherwise(F.raise_error(F.lit("Invalid git signature format.")))
        return F.when(t.isNull(), F.lit(None)).when(t.rlike(_SIGNATURE) & ~F.contains(t, F.lit("\n")), found).otherwise(rest)

    return _once(c(text), parsed)


def _header(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?m)^{name} (.*)$", 1), F.lit(""))


def _message(parts: Column) -> Column:
    """What follows the first blank line, without leading blank lines and one final line end."""
    body = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    return F.regexp_replace(F.regexp_replace(body, "^\n+", ""), "\n\\z", "")


def commit(text: Column | str, strict: bool = True) -> Column:
    """``struct<tree,parents,author,committer,message>``; a missing tree is an error when ``strict``, else null fields.

    Headers are read up to the first blank line; unknown ones don't matter.
    """

    def parsed(parts: Column) -> Column:
        head = F.get(parts, F.lit(0))
        tree = _header(head, "tree")
        if strict:
            tree = F.coalesce(tree, F.raise_error(F.lit("Invalid commit entry: missing tree.")))
        sign = lambda name: signature(_header(head, name), strict).alias(name)
        return F.struct(tree.alias("tree"), F.regexp_extract_all(head, F.lit("(?m)^parent ([0-9a-f]+)$"), 1).alias("parents"), sign("author"), sign("committer"), _message(parts).alias("message"))

    return _once(F.split(c(text), "\n\n", 2), parsed)


def tag(text: Column | str, strict: bool = True) -> Column:
    """``struct<target,target_type,tag,tagger,message>``; the tagger may be missing, the others not when ``strict``."""

    def parsed(parts: Column) -> Column:
        head = F.get(parts, F.lit(0))

        def need(name: str) -> Column:
            found = _header(head, name)
            return F.coalesce(found, F.raise_error(F.lit(f"Invalid tag entry: missing {name}."))) if strict else found

        return F.struct(need("object").alias("target"), need("type").alias("target_type"), need("tag").alias("tag"), signature(_header(head, "tagger"), strict).alias("tagger"), _message(parts).alias("message"))

    return _once(F.split(c(text), "\n\n", 2), parsed)


def chunks(path: Column | str) -> Column:
    """A path's parts without empty ones; arrays of them order paths as directories do."""
    return F.filter(F.split(c(path), "/"), lambda x: x != "")


def contains_path(parent: Column | str, path: Column | str) -> Column:
    """``path`` is ``parent`` or below it, part by part; the empty path contains all."""
    return (c(parent) == "") | (c(path) == c(parent)) | F.startswith(c(path), F.concat(c(parent), F.lit("/")))


def parent_path(path: Column | str) -> Column:
    return F.regexp_replace(c(path), "/?[^/]*$", "")


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(c(path), "([^/]*)$", 1)


def relative_path(root: Column | str, path: Column | str) -> Column:
    """``path`` below ``root`` with forward slashes and none at the ends."""
    plain = lambda x: F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), "/+$", "")
    return F.regexp_replace(F.regexp_replace(F.substring(plain(c(path)), F.length(plain(c(root))) + 1, F.length(c(path))), "^/+", ""), "/+$", "")


def friendly_name(canonical: Column | str, strict: bool = True) -> Column:
    """A branch's short name; other references are an error when ``strict``, else null."""
    found = F.regexp_extract(c(canonical), "^refs/(?:heads|remotes)/(.+)$", 1)
    rest = F.raise_error(F.concat(F.lit("Not a branch: "), c(canonical))) if strict else F.lit(None)
    return F.when(found != "", found).otherwise(rest)


def preview(message: Column | str, length: int = 50) -> Column:
    """The message's first characters on one line, with "..." when it goes on."""
    cut = F.when(F.length(c(message)) > length, F.concat(F.left(c(message), F.lit(length)), F.lit("..."))).otherwise(c(message))
    return F.regexp_replace(cut, "[\r\n]", "")


def change_text(kind: Column | str, old_path: Column | str, new_path: Column | str) -> Column:
    return F.concat(c(kind), F.lit(": "), F.coalesce(c(old_path), F.lit("null")), F.lit(" -> "), F.coalesce(c(new_path), F.lit("null")))


def line_set(text: Column | str) -> Column:
    """The set of a text's lines for similarity: split at line feeds, carriage returns ignored, no empty tail."""
    lines = F.split(F.replace(c(text), F.lit("\r"), F.lit("")), "\n")
    tail = F.endswith(c(text), F.lit("\n")) | (c(text) == "")
    return F.array_distinct(F.when(tail, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines))


def fnv1a(text: Column | str) -> Column:
    """32-bit FNV-1a of the text's bytes without carriage returns, as an unsigned number."""
    digits = F.hex(F.replace(c(text), F.lit("\r"), F.lit("")).cast("binary"))
    count = (F.length(digits) / 2).cast("int")
    at = lambda i: F.conv(F.substring(digits, (i * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("long")
    codes = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), at)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF)))
