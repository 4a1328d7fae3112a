"""Column expressions for sites, hosts and registered domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _canonical_origin(c: Column) -> Column:
    c = F.regexp_replace(F.lower(F.trim(c)), "/+$", "")
    c = F.regexp_replace(c, "^([a-z][a-z0-9+.-]*://)[^/@]*@", "$1")
    return F.regexp_replace(c, ":443$", "")


def site_of(origin: Column, url: Column) -> Column:
    """The site: the origin without differences in host case, trailing slash and port 443.

    Where the origin is null or blank it is the scheme and host (with a port other
    than 443) of the url. Null where neither is given.
    """
    from_url = F.regexp_extract(url, "^\\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+)", 1)
    return F.nullif(
        F.coalesce(_canonical_origin(F.nullif(F.trim(origin), F.lit(""))), _canonical_origin(from_url)), F.lit("")
    )


def host_of(site: Column) -> Column:
    return F.nullif(F.regexp_extract(site, "^[a-z][a-z0-9+.-]*://([^/:?#]+)", 1), F.lit(""))


def registered_domain(host: Column) -> Column:
    """The last two labels of the host; a host of one label is its own domain."""
    parts = F.split(F.regexp_replace(host, "\\.+$", ""), "\\.")
    return F.when(F.size(parts) <= 2, F.array_join(parts, ".")).otherwise(F.array_join(F.slice(parts, -2, 2), "."))


#: Public suffixes of more than one label that sites are commonly registered under; pass another list for more.
PUBLIC_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "net.uk", "me.uk", "ltd.uk", "plc.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au",
    "co.nz", "org.nz", "net.nz", "govt.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "co.kr", "or.kr", "com.br", "org.br", "net.br", "gov.br",
    "com.cn", "net.cn", "org.cn", "gov.cn", "com.tw", "com.hk", "com.sg", "com.my", "com.mx", "com.ar", "com.tr", "com.ua", "com.pl", "co.in",
    "net.in", "org.in", "co.za", "org.za", "co.il", "org.il", "co.id", "co.th", "com.vn", "com.ph", "com.co", "com.pe", "com.ve", "com.eg",
    "github.io", "gitlab.io", "pages.dev", "netlify.app", "vercel.app", "web.app", "firebaseapp.com", "herokuapp.com", "blogspot.com",
    "readthedocs.io", "azurewebsites.net", "cloudfront.net", "fly.dev", "workers.dev",
)


def registrable_domain(host: Column, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> Column:
    """The label before the public suffix, with it; an address or a bare suffix is its own domain."""
    bare = F.regexp_replace(F.lower(host), "\\.+$", "")
    parts = F.split(bare, "\\.")
    last = lambda n: F.array_join(F.slice(parts, -n, n), ".")
    domain = F.when(last(2).isin(list(suffixes)), last(3)).otherwise(last(2))
    return F.when((F.size(parts) <= 2) | bare.rlike(r"^[0-9.]+$|:"), bare).otherwise(domain)


def site_sql(origin: str, url: str) -> str:
    """The same as :func:`site_of` for DuckDB."""
    c = (
        "regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '/+$', ''),"
        " '^([a-z][a-z0-9+.-]*://)[^/@]*@', '\\1'), ':443$', '')"
    )
    from_url = f"regexp_extract({url}, '^\\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+)', 1)"
    given = f"nullif(trim({origin}), '')"
    return f"nullif(coalesce({c.format(given)}, {c.format(from_url)}), '')"
