"""Rules on identifiers, names, symbols and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import OPERATING, RESIDUAL_WORDS
from tidemark.functions.cleaning import blank

# Country names to the prefix their codes carry.
ISO_OF_COUNTRY = {
    "United States": "US", "United Kingdom": "GB", "Germany": "DE", "France": "FR",
    "Italy": "IT", "Spain": "ES", "Netherlands": "NL", "Switzerland": "CH", "Sweden": "SE",
    "Norway": "NO", "Finland": "FI", "Denmark": "DK", "Austria": "AT", "Belgium": "BE",
    "Portugal": "PT", "Greece": "GR", "Ireland": "IE",
}

# Words that carry no identity in a company name.
STOP_WORDS = (
    "inc corp corporation co company companies plc ltd limited group holding holdings the class "
    "a b c common stock etf sa nv ag lp trust international and of new series shares fund reit "
    "sab de cv ab as spa nva"
).split()

# Legal-form words dropped before two names are compared.
LEGAL_FORMS = (
    "corp corporation inc plc ltd limited ag sa spa nv oyj asa se holding holdings group company "
    "co lp llc the"
).split()

# Words that mark a fund.
FUND_WORDS = ("etf", "fund", "trust", "shares", "index", "portfolio", "ucits")

# Query parameters of a signed link.
SIGNED_QUERY = r"(?i)[?&](X-Amz-|AWSAccessKeyId=|Signature=|Expires=)"
SIGNED_NOTE = "  [signed query removed]"

# Shapes of credentials.
SECRET_SHAPES = (
    ("temporary access key id", "ASIA[A-Z0-9]{16}"),
    ("access key id", "AKIA[A-Z0-9]{16}"),
    ("signed link credential", "X-Amz-Credential="),
    ("session token", "X-Amz-Security-Token="),
    ("access key in a query", "AWSAccessKeyId="),
    ("code host token", "gh[pousr]_[A-Za-z0-9]{36}"),
    ("private key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("api key assignment", "(?i)api[_-]?key[\"']?\\s*[:=]\\s*[\"'][A-Za-z0-9_\\-]{16,}"),
)

# Symbol shapes that are no primary listing, tested in this order.
SUSPECT_ROOTS = (
    ("preferred share", r"-P[A-Z]?$"),
    ("preferred series", r"^[A-Z]{1,4}PR[A-Z]?$"),
    ("international line", r"^0[A-Z0-9]{3}$"),
)
SUSPECT_SUFFIX = ("regional floor", r"\.(F|BE|MU|SG|DU|HM)$")

# Minor currency units, the major unit and the divisor.
MINOR_UNITS = (("GBp", "GBP", 100.0), ("ILA", "ILS", 100.0))


def flag(c: Column) -> Column:
    """Text 'true' in any case."""
    return F.lower(F.trim(c)) == "true"


def has_lei(c: Column) -> Column:
    """A legal entity identifier has 20 characters."""
    return ~blank(c) & (F.length(F.trim(c)) == 20)


def identified(*ids: Column) -> Column:
    """At least one identifier is present."""
    out = F.lit(False)
    for c in ids:
        out = out | ~blank(c)
    return out


def operating(status: Column, kept: tuple[str, ...] = OPERATING) -> Column:
    """Any status of a '|'-joined set is an operating one."""
    wanted = F.array(*[F.lit(s) for s in kept])
    return F.coalesce(F.arrays_overlap(F.split(F.lower(F.trim(status)), r"\|"), wanted), F.lit(False))


def domestic(code: Column, iso: Column) -> Column:
    """The first two letters of the code are the home country."""
    return F.coalesce(F.substring(code, 1, 2) == iso, F.lit(False))


def equity_issue(code: Column) -> Column:
    """US codes must carry a numeric issue number that ends in 0; others pass."""
    return F.when(~code.startswith("US"), F.lit(True)).otherwise(
        F.substring(code, 9, 2).rlike("^[0-9]0$")
    )


def unsigned_link(url: Column) -> Column:
    """Drop the query of a signed link, keep the path."""
    return F.when(
        url.rlike(SIGNED_QUERY), F.concat(F.element_at(F.split(url, r"\?"), 1), F.lit(SIGNED_NOTE))
    ).otherwise(url)


def residual(name: Column, words: tuple[str, ...] = RESIDUAL_WORDS) -> Column:
    """The party is an unnamed remainder."""
    return F.coalesce(F.lower(name).rlike("|".join(words)), F.lit(False))


def plain_name(name: Column) -> Column:
    """Lower case, legal forms and punctuation removed, single blanks."""
    forms = r"\b(" + "|".join(LEGAL_FORMS) + r")\b\.?"
    cleared = F.regexp_replace(F.lower(name), forms, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(cleared, "[^a-z0-9 ]", " "), " +", " "))


def name_tokens(name: Column) -> Column:
    """Distinct words longer than one letter that are not stop words."""
    words = F.split(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " "), " +")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.array_except(F.array_distinct(words), stop), lambda w: F.length(w) > 1)


def suspect_symbol(symbol: Column) -> Column:
    """First matching reason on the root, else the suffix rule, else null."""
    root = F.split_part(symbol, F.lit("."), F.lit(1))
    why = None
    for label, shape in SUSPECT_ROOTS:
        why = F.when(root.rlike(shape), label) if why is None else why.when(root.rlike(shape), label)
    return why.when(symbol.rlike(SUSPECT_SUFFIX[1]), SUSPECT_SUFFIX[0])


def equity_record(sector: Column, kind: Column, ticker: Column, exchange: Column) -> Column:
    """An equity of a plain share class with a ticker and an exchange."""
    return (
        (sector == "Equity") & kind.isin("Common Stock", "Depositary Receipt")
        & ticker.isNotNull() & exchange.isNotNull()
    )
