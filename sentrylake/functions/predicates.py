"""Field-match predicates. Each gives a non-null boolean: a predicate over an absent field is false."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def present(field: Column) -> Column:
    """Empty text is absent."""
    return F.when(field != "", field)


def two_valued(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


UTF16 = {"utf16le": ("utf-16-le", b""), "wide": ("utf-16-le", b""), "utf16be": ("utf-16-be", b""), "utf16": ("utf-16-le", b"\xff\xfe")}  # fixed values


def encoded(value: str, how: str | None) -> list[str]:
    """Base64 forms of a value, which may be made UTF-16 first: "base64", "utf16le+base64".

    base64offset gives the forms when 0, 1 or 2 bytes come before the value, less the characters that those bytes make
    alone; base64offset_strict also drops those that bytes beside the value change in part, so embedded text is found.
    """
    if how is None:
        return [value]
    first, _, last = how.rpartition("+")
    if first and first not in UTF16:
        raise ValueError(f"unknown encoding {first}")
    charset, mark = UTF16[first] if first else ("utf-8", b"")
    data = mark + value.encode(charset)
    if last == "base64":
        return [base64.b64encode(data).decode()]
    if last in ("base64offset", "base64offset_strict"):
        out = []
        for k in range(3):
            text = base64.b64encode(b"\0" * k + data).decode().rstrip("=")
            full = (k + len(data)) * 8 // 6  # characters that depend on the value alone
            out.append(text[(0, 2, 3)[k] : full] if last.endswith("strict") else text[k * 4 // 3 :])
        return [x for x in out if x]
    raise ValueError(f"unknown encoding {how}")


class Field:
    """m("Image").endswith("/bash", "/sudo"): values are alternatives; with all=True every one must match."""

    def __init__(self, name: str | Column, many: bool = False):
        self.column = F.col(name) if isinstance(name, str) else name
        self.many = many

    def _held(self, test) -> Column:
        """`test` of the field's value; of an array field, of some value that it holds."""
        return two_valued(F.exists(self.column, lambda x: two_valued(test(present(x)))) if self.many else test(present(self.column.cast("string"))))

    def _match(self, test, values, cased: bool, every: bool, encode: str | None = None) -> Column:
        if not values:
            raise ValueError("a predicate needs a value")
        forms = [[F.lit(x if cased else x.lower()) for x in encoded(v, encode)] for v in map(str, values)]
        fold = (lambda f: f) if cased else F.lower
        tests = [self._held(lambda f, own=own: reduce(or_, [test(fold(f), x) for x in own])) for own in forms]
        return two_valued(reduce(and_ if every else or_, tests))

    def equals(self, *values, cased=False, all=False, encode=None) -> Column:
        return self._match(lambda f, v: f == v, values, cased, all, encode)

    def contains(self, *values, cased=False, all=False, encode=None) -> Column:
        return self._match(lambda f, v: F.contains(f, v), values, cased, all, encode)

    def startswith(self, *values, cased=False, all=False) -> Column:
        return self._match(lambda f, v: F.startswith(f, v), values, cased, all)

    def endswith(self, *values, cased=False, all=False) -> Column:
        return self._match(lambda f, v: F.endswith(f, v), values, cased, all)

    def regex(self, *patterns, flags="", all=False) -> Column:
        """Unanchored find; minds case unless flags has i."""
        tests = [self._held(lambda f, p=p: f.rlike(f"(?{flags}){p}" if flags else p)) for p in patterns]
        return two_valued(reduce(and_ if all else or_, tests))

    def wide(self, value: str, encoding: str = "utf-16-le", bom: bool = False) -> Column:
        """The value's UTF-16 bytes stand in the field's bytes; with `bom`, behind a byte order mark."""
        found = (b"\xff\xfe" if bom else b"") + value.encode(encoding)
        return two_valued(F.contains(self.column.cast("binary"), F.lit(found)))

    def compare(self, op: str, number: float) -> Column:
        """Both sides as doubles; text that isn't a number is false."""
        text = self.column.cast("string")
        value = F.when(text.rlike(NUMBER), text.try_cast("double"))
        tests = {"gt": value > number, "gte": value >= number, "lt": value < number, "lte": value <= number}
        return two_valued(tests[op])

    def cidr(self, *blocks) -> Column:
        inside = lambda digits, number: reduce(or_, [_in_block(digits, number, b) for b in blocks])
        return two_valued(once(self.column, lambda ip: once(ipv6_hex(ip), lambda digits: once(_ipv4_number(ip, digits), lambda number: inside(digits, number)))))

    def is_absent(self) -> Column:
        return present(self.column.cast("string")).isNull()

    def exists(self, wanted: bool = True) -> Column:
        return present(self.column.cast("string")).isNotNull() == F.lit(wanted)

    def any_of(self, *values) -> Column:
        """Of an array field: some element equals a value, case aside."""
        return Field(self.column, many=True).equals(*values)


def m(name: str | Column, many: bool = False) -> Field:
    """A field by name; `many` for an array field, of which any value may match."""
    return Field(name, many)


OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"{OCTET}(\.{OCTET}){{3}}"
GROUP = "[0-9a-f]{1,4}"
MAPPED = "0" * 20 + "ffff"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once a row, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _dotted_number(text: Column) -> Column:
    return once(F.split(text, r"\."), lambda parts: reduce(lambda a, k: a * 256 + F.get(parts, k).cast("bigint"), range(1, 4), F.get(parts, 0).cast("bigint")))


def _ipv4_number(ip: Column, digits: Column) -> Column:
    mapped = F.when(F.startswith(digits, F.lit(MAPPED)), F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint"))
    return F.when(ip.contains(":"), mapped).when(ip.rlike(f"^{DOTTED}$"), _dotted_number(ip))


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number, unmapped from IPv6; null for anything else. A block is a range of it, so project it once."""
    return once(ipv6_hex(ip), lambda digits: _ipv4_number(ip, digits))


def in_block(number: Column, block: str) -> Column:
    """Whether an IPv4 address's number (see `ipv4_number`) is in a block."""
    import ipaddress

    net = ipaddress.ip_network(block, strict=False)
    return two_valued(number.between(int(net.network_address), int(net.broadcast_address)))


def ipv6_hex(ip: Column) -> Column:
    """32 hex digits of an IPv6 address without a zone; null for anything else.

    Eight groups, or fewer with one `::` for a group or more; the last two may be a dotted IPv4 address.
    """
    in_hex = lambda n: once(F.lpad(F.lower(F.hex(n)), 8, "0"), lambda h: F.concat(F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))

    def plain(text: Column, dotted: Column) -> Column:
        return F.when(dotted != "", F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(dotted)), in_hex(_dotted_number(dotted)))).otherwise(text)

    def groups(half: Column) -> Column:
        return F.filter(F.split(half, ":"), lambda x: x != "")

    def filled(text: Column) -> Column:
        """The eight groups."""

        def short(head: Column, tail: Column) -> Column:
            missing = 8 - F.size(head) - F.size(tail)
            return F.when(missing >= 1, F.concat(head, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), missing)), tail))

        halves = lambda h: once(groups(F.get(h, 0)), lambda head: once(groups(F.get(h, 1)), lambda tail: short(head, tail)))
        return F.when(text.rlike(f"^({GROUP}(:{GROUP})*)?::({GROUP}(:{GROUP})*)?$"), once(F.split(text, "::", -1), halves)).when(text.rlike(f"^{GROUP}(:{GROUP}){{7}}$"), groups(text))

    def digits(text: Column) -> Column:
        tail = F.when(text.contains("."), F.regexp_extract(text, f":({DOTTED})$", 1)).otherwise("")
        return once(once(tail, lambda dotted: plain(text, dotted)), lambda x: F.array_join(F.transform(filled(x), lambda g: F.lpad(g, 4, "0")), ""))

    return F.when(ip.contains(":"), once(F.lower(ip), digits))


def _in_block(digits: Column, number: Column, block: str) -> Column:
    import ipaddress

    net = ipaddress.ip_network(block, strict=False)
    if net.version == 4:
        return number.between(int(net.network_address), int(net.broadcast_address))
    # a mapped address is an IPv4 one, and in no IPv6 block
    return digits.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}") & ~F.startswith(digits, F.lit(MAPPED))


def ioc_match(df: DataFrame, field: str, feed: DataFrame, out: str = "ioc") -> DataFrame:
    """Flag rows whose field, trimmed and lower-cased, is an entry of the feed. Spark broadcasts the feed only if small."""
    entries = feed.select(F.lower(F.trim(F.col(feed.columns[0]))).alias("_entry")).where("_entry <> ''").distinct().withColumn("_hit", F.lit(True))
    return df.join(entries, F.lower(F.trim(F.col(field))) == F.col("_entry"), "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_entry", "_hit")


def ioc_value(value: Column, kind: str) -> Column:
    """A value as a feed of its kind has it: trimmed, lower case; a domain without its last dot, an address unmapped from IPv6."""
    text = F.lower(F.trim(value))
    if kind == "domain":
        return F.regexp_replace(text, r"\.$", "")
    return F.regexp_replace(text, "^::ffff:", "") if kind == "ipv4" else text


def ioc_match_any(df: DataFrame, field: str, feeds: dict[str, tuple[str, DataFrame]], names: list[str], out: str = "ioc", many: bool = False) -> DataFrame:
    """Flag rows whose field (`many`: an array, any value of it) is an entry of any named feed. feeds: name -> (kind, entries).

    A name that no feed has matches nothing. One join for all feeds: a row meets its own normalised values only.
    """
    known = [feeds[n] for n in dict.fromkeys(names) if n in feeds]
    if not known:
        return df.withColumn(out, F.lit(False))
    entries = reduce(
        lambda a, b: a.unionByName(b),
        [e.select(F.lit(kind).alias("_kind"), ioc_value(F.col(e.columns[0]), kind).alias("_entry")).where("_entry <> ''") for kind, e in known],
    ).distinct()
    kinds = sorted({kind for kind, _ in known})
    values = F.col(field) if many else F.array(F.col(field))

    def as_kind(kind: str) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("_kind"), ioc_value(x, kind).alias("_entry")))

    forms = F.array_distinct(F.flatten(F.array(*map(as_kind, kinds))))
    if not many and len(kinds) == 1:
        keyed = df.withColumn("_entry", ioc_value(F.col(field), kinds[0]))
        return keyed.join(entries.select("_entry", F.lit(True).alias("_hit")), "_entry", "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_entry", "_hit")
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    hits = numbered.select("_row", F.explode(forms).alias("_f")).select("_row", "_f.*").join(entries, ["_kind", "_entry"], "left_semi").select("_row").distinct().withColumn("_hit", F.lit(True))
    return numbered.join(hits, "_row", "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_row", "_hit")


#: The names that rules use, and where a decoded event `p` of the category has them; the first that is there counts.
VOCABULARY = {
    "process_creation": {
        "Image": ["process.file.path"], "ProcessName": ["process.name"], "CommandLine": ["process.cmd_line"], "User": ["process.user.name"],
        "ProcessId": ["process.pid"], "PID": ["process.pid"], "ParentImage": ["process.parent_process.file.path"],
        "ParentCommandLine": ["process.parent_process.cmd_line"], "ParentProcessId": ["process.parent_process.pid"], "PPID": ["process.parent_process.pid"],
    },
    "file_event": {
        "TargetFilename": ["file.path", "file.name"], "Filename": ["file.path", "file.name"], "Path": ["file.path", "file.name"],
        "RenameTo": ["file_diff.path", "file_diff.name"], "NewFilename": ["file_diff.path", "file_diff.name"], "Image": ["actor.process.file.path"],
        "CommandLine": ["actor.process.cmd_line"], "User": ["actor.user.name"], "ProcessId": ["actor.process.pid"], "PID": ["actor.process.pid"],
    },
    "network_connection": {
        "DestinationIp": ["dst_endpoint.ip"], "DestinationPort": ["dst_endpoint.port"], "SourceIp": ["src_endpoint.ip"], "SourcePort": ["src_endpoint.port"],
        "Protocol": ["connection_info.protocol_name"], "Image": ["actor.process.file.path"], "CommandLine": ["actor.process.cmd_line"], "User": ["actor.user.name"],
    },
}


def field_of(category: str, name: str) -> Column:
    """A rule's field as text; empty text and 0 are absent, and so is a name that the category doesn't have."""
    paths = VOCABULARY[category].get(name, [])
    texts = [F.col(f"p.{x}").cast("string") for x in paths]
    return F.coalesce(*[F.when(~t.isin("", "0"), t) if x.rsplit(".", 1)[-1] in ("pid", "port") else F.when(t != "", t) for t, x in zip(texts, paths)], F.lit(None).cast("string"))


def project_fields(df: DataFrame, category: str, names: list[str] | None = None, keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Decoded events with one column for each field of the category, or for each of `names`."""
    return df.select(*keep, *[field_of(category, n).alias(n) for n in names or VOCABULARY[category]])


def selection(branches: dict | list, fields=None) -> Column:
    """A mapping is an AND over its predicates, a list of mappings an OR of those."""
    if isinstance(branches, dict):
        if not branches:
            raise ValueError("an empty selection")
        return reduce(and_, branches.values())
    return reduce(or_, [selection(b) for b in branches])


def n_of(n: int, flags: list[Column] | dict[str, Column], names: str = "them") -> Column:
    """At least n of the flags; n is held to their number. Of named flags, those that `names` tells: a name, a beginning and
    a star, or "them" for all."""
    if isinstance(flags, dict):
        flags = [f for k, f in flags.items() if names == "them" or k == names or (names.endswith("*") and k.startswith(names[:-1]))]
    if not flags:
        raise ValueError("no selection to count")
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags]) >= min(n, len(flags))


def all_of(flags: list[Column] | dict[str, Column], names: str = "them") -> Column:
    return n_of(len(flags), flags, names)


def any_of(flags: list[Column] | dict[str, Column], names: str = "them") -> Column:
    return n_of(1, flags, names)
