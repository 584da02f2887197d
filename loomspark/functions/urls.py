"""URL expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parameters that only track visitors, by use.
ADMISSION_DROPPED = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "src", "srsltid")
LINK_DROPPED = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")
# Public suffixes of two parts.
TWO_LEVEL = (
    "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "ed.jp", "ad.jp", "co.uk", "ac.uk", "org.uk", "gov.uk", "co.kr", "or.kr", "go.kr", "com.au", "net.au", "org.au", "edu.au",
    "com.br", "org.br", "net.br", "com.cn", "net.cn", "org.cn", "co.in", "net.in", "org.in", "co.nz", "net.nz", "org.nz", "com.tw", "org.tw", "net.tw",
)
MAX_LENGTH = 2083


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority(url) -> Column:
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def host(url) -> Column:
    """Lower-case host without user, port and brackets; '' if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", ""), r"[\[\]]", ""))


def path(url) -> Column:
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(url) -> Column:
    return F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)


def fragment(url) -> Column:
    return F.regexp_extract(_c(url), r"#(.*)$", 1)


def url_hash(url) -> Column:
    """Identity of a URL: the first 16 hexadecimal digits of its SHA-256."""
    return F.substring(F.sha2(_c(url), 256), 1, 16)


def registered_domain(url) -> Column:
    parts = F.split(host(url), r"\.")
    n = F.size(parts)
    last = lambda k: F.concat_ws(".", F.slice(parts, F.greatest(n - k + 1, F.lit(1)), F.lit(k)))
    return F.when(n <= 2, host(url)).when(last(2).isin(*TWO_LEVEL), last(3)).otherwise(last(2))


def _encode(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _pairs(url, dropped, ignore_case: bool) -> Column:
    """The kept (key, value) pairs of the query, decoded."""
    parts = F.filter(F.split(query(url), "&"), lambda p: p != "")
    decoded = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("%"), F.lit("%"))), x)
    pairs = F.transform(parts, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(F.lit(""))).alias("v")))
    return F.filter(pairs, lambda p: ~(F.lower(p["k"]) if ignore_case else p["k"]).isin(*dropped))


def _joined(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def normalize_for_admission(url) -> Column:
    """Lower scheme and host; no user, fragment or default port; tracking parameters dropped, the rest sorted; null if invalid."""
    u, s, h = _c(url), scheme(url), host(url)
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    port = F.regexp_extract(bare, r":(\d+)$", 1)
    bad = ~s.isin("http", "https") | (h == "") | bare.rlike(r":[^\]]*[^0-9\]][^\]]*$") | (~bare.startswith("[") & bare.rlike(r":.*:")) | (F.coalesce(port.try_cast("long"), F.lit(0)) > 65535)
    shown = F.when(bare.startswith("["), F.concat(F.lit("["), h, F.lit("]"))).otherwise(h)
    net = F.when((port == "") | (port == "0") | ((s == "http") & (port == "80")) | ((s == "https") & (port == "443")), shown).otherwise(F.concat(shown, F.lit(":"), port))
    q = _joined(F.array_sort(_pairs(url, ADMISSION_DROPPED, True)))
    out = F.concat(s, F.lit("://"), net, path(url), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
    return F.when(u.isNull() | bad | (F.length(out) > MAX_LENGTH), None).otherwise(out)


def with_links(df: DataFrame, base: str, link: str, name: str) -> DataFrame:
    """Adds a link resolved against its page: no fragment, http(s) only, tracking parameters dropped, order and port kept; null if invalid.

    The steps are columns of their own, so that each part of an address is taken once."""
    b, raw, keep = F.col(base), F.col("_raw"), df.columns
    df = df.withColumn("_raw", F.regexp_replace(F.trim(F.col(link)), "#.*$", "")).withColumn("_whole", raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"))
    root = F.concat(scheme(b), F.lit("://"), authority(b))
    folder = F.regexp_replace(path(b), r"[^/]*$", "")
    full = (
        F.when(F.col("_whole"), raw)
        .when(raw.startswith("//"), F.concat(scheme(b), F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(root, raw))
        .when(raw.startswith("?"), F.concat(root, path(b), raw))
        .when(raw == "", F.regexp_replace(b, "#.*$", ""))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), raw))
    )
    df = df.withColumn("_full", full).withColumn("_full", F.when(F.col("_full").contains("/."), F.regexp_replace(F.regexp_replace("_full", r"/\./", "/"), r"/[^/?]+/\.\./", "/")).otherwise(F.col("_full")))
    df = df.withColumn("_scheme", scheme("_full")).withColumn("_net", F.regexp_replace(authority("_full"), r"^.*@", "")).withColumn("_path", path("_full"))
    df = df.withColumn("_port", F.regexp_extract("_net", r":(\d+)$", 1)).withColumn("_host", F.lower(F.regexp_replace("_net", r":\d*$|[\[\]]", "")))
    df = df.withColumn("_query", F.when(F.col("_full").contains("?"), _joined(_pairs("_full", LINK_DROPPED, False))).otherwise(""))
    out = F.concat("_scheme", F.lit("://"), "_host", F.when(F.col("_port") == "", F.lit("")).otherwise(F.concat(F.lit(":"), "_port")), "_path", F.when(F.col("_query") == "", F.lit("")).otherwise(F.concat(F.lit("?"), "_query")))
    valid = F.col(link).isNotNull() & (F.col(link) != "") & F.col("_scheme").isin("http", "https") & (F.length("_full") <= MAX_LENGTH)
    return df.select(*keep, F.when(valid, out).alias(name))


def private_ipv4(name) -> Column:
    """Is a host an IPv4 literal that is private, loopback, link-local, unspecified or reserved?"""
    h = _c(name)
    octet = lambda i: F.get(F.split(h, r"\."), i - 1).try_cast("int")
    valid = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    a, b = octet(1), octet(2)
    return F.when(valid, a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | (a >= 240)).otherwise(F.lit(False))


def suffixes(name) -> Column:
    """A domain and all its parents, longest first."""
    parts = F.split(_c(name), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))


def wildcard(url, pattern: str) -> Column:
    """`*pattern*` over the whole URL; * and ? in the pattern are wildcards."""
    text = "".join("%" if c == "*" else "_" if c == "?" else "\\" + c if c in "%_\\" else c for c in pattern)
    return _c(url).like(f"%{text}%")
