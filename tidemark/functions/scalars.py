"""Scalar functions over columns: paths, query strings, addresses, topics, redaction.

All of them answer null or "no match" on malformed input and never raise, also
with ANSI mode on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def remove_dot_segments(path: Column) -> Column:
    """Resolves `.` and `..`, drops empty segments in the middle and keeps the slash behind a last `.` or `..`."""

    def resolved(parts: Column) -> Column:
        last = F.size(parts) - 1
        numbered = F.arrays_zip(parts.alias("s"), F.sequence(F.lit(0), last).alias("i"))

        def step(out, item):
            s, end = item["s"], item["i"] == last
            dot, up = s == ".", s == ".."
            shorter = F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)
            base = F.when(up, shorter).otherwise(out)
            return F.when(dot | up, F.when(end, F.concat(base, F.array(F.lit("")))).otherwise(base)).when((s == "") & ~end, out).otherwise(F.concat(out, F.array(s)))

        return F.array_join(F.aggregate(numbered, F.array(F.lit("")), step), "/")

    return bind(bind(F.split(path, "/", -1), resolved), lambda joined: F.when(joined == "", "/").otherwise(joined))


def percent_decode(text: Column) -> Column:
    """One pass of percent-decoding; null on malformed escapes or bytes that aren't UTF-8. `+` stays."""

    def decode(t: Column) -> Column:
        bad = t.rlike("%(?![0-9A-Fa-f]{2})")
        # Bytes that aren't UTF-8 come back as U+FFFD; a text that spells U+FFFD itself is fine.
        spelt = t.rlike("(?i)\ufffd|%EF%BF%BD")
        return bind(F.try_url_decode(F.regexp_replace(t, r"\+", "%2B")), lambda d: F.when(~bad & (spelt | ~d.contains("\ufffd")), d))

    return bind(text, decode)


def canonical_path(path: Column) -> Column:
    """At most two passes of percent-decoding, the last good one counting, then dot segments. Case stays."""

    def again(once: Column) -> Column:
        return F.when(once.contains("%"), F.coalesce(percent_decode(once), once)).otherwise(once)

    def clean(p: Column) -> Column:
        plain = ~(p.contains("%") | p.contains("//") | p.contains("/."))
        decoded = bind(percent_decode(p), lambda once: F.when(once.isNull(), p).otherwise(again(once)))
        return F.when(plain, p).otherwise(remove_dot_segments(decoded))

    return bind(path, clean)


def parse_query(query: Column) -> Column:
    """array<struct<name, value>> in order: `+` is a space, names and values decode apart and stay raw where they can't."""

    def decoded(s):
        spaced = F.regexp_replace(s, r"\+", " ")
        return F.coalesce(percent_decode(spaced), s)

    pairs = F.filter(F.split(F.coalesce(query, F.lit("")), "&", -1), lambda p: p != "")
    at = lambda p: F.instr(p, "=")
    return F.transform(pairs, lambda p: F.struct(decoded(F.when(at(p) > 0, F.substring_index(p, "=", 1)).otherwise(p)).alias("name"), decoded(F.when(at(p) > 0, p.substr(at(p) + 1, F.length(p))).otherwise(F.lit(""))).alias("value")))


def query_values(query: Column, name: str) -> Column:
    """All values of a parameter, in order; names are case-sensitive."""
    return F.transform(F.filter(parse_query(query), lambda p: p["name"] == name), lambda p: p["value"])


def normal_ip(ip: Column) -> Column:
    """An IPv4 address that is mapped into IPv6 (`::ffff:`, lower case only) as itself."""
    return F.when(ip.startswith("::ffff:") & ip.contains("."), F.substring(ip, 8, 64)).otherwise(ip)


def ipv4_number(ip: Column) -> Column:
    """A strict dotted quad as a number, null for anything else."""

    def number(parts: Column) -> Column:
        at = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
        return at(0) * (1 << 24) + at(1) * (1 << 16) + at(2) * (1 << 8) + at(3)

    return F.when(ip.rlike(IPV4), bind(F.split(ip, r"\."), number))


def ipv6_hex(ip: Column) -> Column:
    """32 hex digits of an IPv6 address (zone dropped, `::` filled, last quad dotted or not), null for anything else."""
    groups = lambda s: F.filter(F.split(s, ":", -1), lambda g: g != "")

    def undotted(bare: Column) -> Column:
        tail = F.substring_index(bare, ":", -1)
        quad = lambda n: F.concat(F.substring(bare, F.lit(1), F.length(bare) - F.length(tail)), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF))))
        return F.when(tail.contains("."), bind(ipv4_number(tail), quad)).otherwise(bare)

    def filled(plain: Column) -> Column:
        halves = F.split(plain, "::", -1)
        two = F.size(halves) == 2

        def joined(both: Column) -> Column:
            head, rest = both["head"], both["rest"]
            missing = 8 - F.size(head) - F.size(rest)
            whole = F.concat(head, F.array_repeat(F.lit("0"), F.when(two, F.greatest(missing, F.lit(0))).otherwise(0)), rest)
            fits = ((F.size(halves) == 1) & (F.size(head) == 8)) | (two & (missing >= 1))
            return F.when(fits, F.array_join(F.transform(whole, lambda g: F.lpad(F.lower(g), 4, "0")), ""))

        fair = plain.contains(":") & plain.rlike(r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?(?:::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)?$")
        both = F.struct(groups(F.get(halves, F.lit(0))).alias("head"), F.when(two, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("rest"))
        return F.when(fair, bind(both, joined))

    return bind(bind(F.substring_index(ip, "%", 1), undotted), filled)


def cidr_range(cidr: Column) -> Column:
    """struct<low, high> of numbers of an IPv4 range (no length: 32), null if malformed."""
    address, bits = F.substring_index(cidr, "/", 1), F.when(cidr.contains("/"), F.substring_index(cidr, "/", -1)).otherwise("32")
    n = F.when(bits.rlike(r"^\d{1,3}$") & (F.size(F.split(cidr, "/")) <= 2), bits.try_cast("int"))

    def spanned(x: Column) -> Column:
        block = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - x["n"])
        low = x["ip"] - x["ip"] % block
        return F.when((x["n"] <= 32) & x["ip"].isNotNull(), F.struct(low.alias("low"), (low + block - 1).alias("high")))

    return bind(F.struct(n.alias("n"), ipv4_number(normal_ip(address)).alias("ip")), spanned)


def cidr6_prefix(cidr: Column) -> Column:
    """struct<prefix, bits> of an IPv6 range: the address' first bits as a string of 0s and 1s; null if malformed."""
    address, bits = F.substring_index(cidr, "/", 1), F.when(cidr.contains("/"), F.substring_index(cidr, "/", -1)).otherwise("128")
    n = F.when(bits.rlike(r"^\d{1,3}$"), bits.try_cast("int"))
    return bind(ipv6_bits(address), lambda digits: F.when((n <= 128) & digits.isNotNull(), F.struct(F.substring(digits, F.lit(1), n).alias("prefix"), n.alias("bits"))))


def ipv6_bits(ip: Column) -> Column:
    """The 128 bits of an IPv6 address as 0s and 1s, null for anything else."""
    return bind(ipv6_hex(ip), lambda digits: F.when(digits.isNotNull(), F.concat(*[F.lpad(F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(4)])))


def unsafe_regex(pattern: str) -> bool:
    """Whether a pattern needs more than linear time: back references, look-around, or one that can't be compiled."""
    plain = re.sub(r"\\\\", "", pattern)
    if re.search(r"\\[1-9]|\\k<|\(\?P=|\(\?<?[=!]|\(\?>|[*+?}]\+", plain):
        return True
    try:
        re.compile(pattern)
    except re.error:
        return True
    return False


def compare(op: str, value: Column, wanted: str | None) -> Column:
    """exists, equals, contains, prefix or regex of one value."""
    if op == "exists":
        return value.isNotNull()
    test = {"equals": lambda: value == wanted, "contains": lambda: value.contains(wanted), "prefix": lambda: value.startswith(wanted), "regex": lambda: value.rlike(wanted)}[op]()
    return F.coalesce(test, F.lit(False))


def topic_regex(topic_filter: str) -> str:
    """An anchored pattern for a topic filter: `+` is one level, a last `#` all that follows, the level before included."""
    out, levels = "", topic_filter.split("/")
    for i, level in enumerate(levels):
        if level == "#":
            out = out[:-1] + "(?:/.*)?" if i else ".*"
            break
        out += ("[^/]*" if level == "+" else re.sub(r"([^\w])", r"\\\1", level)) + "/"
    return "^" + (out if levels[-1] == "#" else out[:-1]) + "$"


def topic_matches(topic: Column, topic_filter: str) -> Column:
    return F.coalesce(topic.rlike(topic_regex(topic_filter)), F.lit(False))


def redacted(df, secrets=("token", "key", "password", "hdbAuthHeader")):
    """The frame with values of secret columns masked where there are any."""
    return df.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit("[redacted]")).alias(c) if c in secrets else F.col(f"`{c}`") for c in df.columns])


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def url_path(url: Column) -> Column:
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.when(path == "", "/").otherwise(path)


def url_query(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"))


def node_url(name: Column, port: Column | None = None, secure: Column | None = None) -> Column:
    """ws(s)://name:port of a node name; a name that is a URL already stays."""
    scheme = F.when(secure, "wss://").otherwise("ws://") if secure is not None else F.lit("wss://")
    return F.when(name.contains("://"), name).otherwise(F.concat(scheme, name, F.coalesce(F.concat(F.lit(":"), port.cast("string")), F.lit("")) if port is not None else F.lit("")))


def epoch_ms(time: Column) -> Column:
    """Milliseconds of a number or a strict ISO-8601 UTC text, null for anything else."""
    number = time.try_cast("double")
    strict = time.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?Z$")
    stamp = F.try_to_timestamp(time)
    return F.coalesce(number, F.when(strict, F.unix_micros(stamp) / 1000.0))


def start_time_ms(text: Column, number: Column | None = None) -> Column:
    """Milliseconds of a number, or of ISO-8601 text with Z or an offset; null for any other text, which a caller rejects."""
    strict = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?(?:Z|[+-]\d{2}:\d{2})$")
    parsed = F.when(strict, F.unix_micros(F.try_to_timestamp(text)) / 1000.0)
    return parsed if number is None else F.coalesce(F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number), parsed)


def iso_utc(ms: Column) -> Column:
    """ISO-8601 UTC text of milliseconds."""
    return F.date_format(F.timestamp_millis(ms.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def size_bucket(text: Column, buckets: int) -> Column:
    """A 31-hash of the characters in wrapping 32-bit arithmetic, as a bucket number."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    wrapped = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c) % (1 << 32))
    return F.abs(F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped)) % buckets
