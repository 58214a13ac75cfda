"""Who a source is: canonical names, domains, countries, languages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names of an outlet, by its canonical id.
ALIASES = {
    "reuters": ("reuters", "reuters.com", "www.reuters.com", "thomson reuters", "thomson-reuters", "reuters news agency", "reuters uk", "reuters us"),
    "afp": ("afp", "agence france-presse", "agence france presse", "afp news", "afp english"),
    "associated-press": ("ap", "associated press", "the associated press", "apnews.com", "ap news", "ap newswire"),
    "united-press-international": ("upa", "upi", "united press international"),
    "dpa": ("dpa", "dpa international", "dpa-international", "deutsche presse-agentur"),
    "efe": ("efe", "agencia efe", "efe news agency"),
    "tass": ("itar-tass", "tass", "tass.com", "tass russian news agency"),
    "xinhua": ("xinhua", "xinhuanet.com", "xinhua news agency", "新华社"),
    "bbc": ("bbc", "bbc news", "bbc.com", "bbc.co.uk", "bbc world service"),
    "cnn": ("cnn", "cnn.com", "cnn international", "cnn breaking news"),
    "nyt": ("the new york times", "new york times", "nytimes.com", "nyt"),
    "guardian": ("the guardian", "guardian", "theguardian.com", "guardian us", "guardian uk"),
    "washington-post": ("the washington post", "washington post", "washingtonpost.com", "wapo", "wp"),
    "wsj": ("the wall street journal", "wall street journal", "wsj", "wsj.com"),
    "al-jazeera": ("al jazeera", "aljazeera", "aljazeera.com", "al jazeera english", "al-jazeera"),
    "ft": ("financial times", "the financial times", "ft", "ft.com"),
    "bloomberg": ("bloomberg", "bloomberg.com", "bloomberg news", "bloomberg l.p."),
    "economist": ("the economist", "economist.com", "economist"),
    "le-monde": ("le monde", "lemonde.fr"),
    "spiegel": ("der spiegel", "spiegel", "spiegel.de"),
    "politico": ("politico", "politico.com", "politico eu", "politico europe"),
}
# Country of a source by the end of its domain.
SOURCE_SUFFIXES = {
    "co.uk": "GB", "uk": "GB", "fr": "FR", "de": "DE", "it": "IT", "es": "ES", "nl": "NL", "pt": "PT", "com.br": "BR", "br": "BR",
    "au": "AU", "ca": "CA", "cn": "CN", "jp": "JP", "kr": "KR", "ru": "RU", "co.in": "IN", "in": "IN", "co.za": "ZA", "za": "ZA",
    "ng": "NG", "ke": "KE", "eg": "EG", "ar": "AR", "mx": "MX", "tr": "TR", "se": "SE", "no": "NO", "pl": "PL",
}
# Country of an archived page's domain by its last one or two labels.
ARCHIVE_SUFFIXES = {
    "co.uk": "GB", "uk": "GB", "de": "DE", "fr": "FR", "es": "ES", "it": "IT", "nl": "NL", "ru": "RU", "com.cn": "CN", "cn": "CN",
    "co.jp": "JP", "jp": "JP", "kr": "KR", "co.in": "IN", "in": "IN", "com.br": "BR", "br": "BR", "tr": "TR", "gr": "GR", "co.id": "ID",
    "id": "ID", "ua": "UA", "pl": "PL", "se": "SE", "no": "NO", "com.au": "AU", "au": "AU", "ca": "CA", "co.za": "ZA", "za": "ZA",
    "ng": "NG", "ke": "KE", "eg": "EG", "com.ar": "AR", "ar": "AR", "com.mx": "MX", "mx": "MX", "sa": "SA", "ae": "AE", "qa": "QA",
    "pk": "PK", "ph": "PH", "vn": "VN", "th": "TH", "my": "MY", "sg": "SG", "pt": "PT", "ir": "IR", "il": "IL",
}
LANGUAGE_COUNTRY = {
    "ar": "SA", "de": "DE", "es": "ES", "fr": "FR", "hi": "IN", "it": "IT", "ja": "JP", "ko": "KR", "nl": "NL", "pl": "PL", "pt": "BR",
    "ru": "RU", "sv": "SE", "tr": "TR", "uk": "UA", "zh": "CN",
}
LANGUAGE_3_TO_2 = {
    "eng": "en", "fra": "fr", "spa": "es", "deu": "de", "ger": "de", "rus": "ru", "zho": "zh", "cmn": "zh", "ara": "ar", "por": "pt",
    "ita": "it", "jpn": "ja", "kor": "ko", "hin": "hi", "tur": "tr", "ell": "el", "ind": "id", "ukr": "uk", "nld": "nl", "pol": "pl",
    "vie": "vi", "tha": "th", "fas": "fa", "heb": "he", "swe": "sv", "nor": "no", "fin": "fi", "ces": "cs",
}
HARD_REJECTED = (
    "wikipedia.org wikimedia.org wiktionary.org fandom.com wikihow.com reddit.com x.com twitter.com facebook.com instagram.com tiktok.com "
    "pinterest.com quora.com medium.com tumblr.com linkedin.com imgur.com"
).split()
PRIMARY_MARKERS = (
    "statement", "press release", "communiqué", "communique", "official", "ministry", "department", "commission", "authority", "regulator",
    "central bank", "reserve bank", "federal reserve", "document", "dataset", "filing", "transcript",
)
PRIMARY_NAMES = "statement communiqué communique ministry préfecture prefecture official dataset document filing registry gazette".split()
PRIMARY_DOMAINS = "europa.eu un.org imf.org worldbank.org bis.org oecd.org who.int nato.int icc-cpi.int wto.org".split()
PROVENANCE_MARKERS = (
    "according to", "said", "says", "told", "reported", "reports", "stated", "stating", "announced", "confirm", "revealed", "cited",
    "citing", "alleged", "denied", "wrote", "source", "sources", "official", "spokesperson", "spokesman", "statement", "briefing",
    "documents", "filing", "study", "survey", "data show", "we found", "this paper", "our investigation", "has learned", "understands",
    "interview", '"', "“",
)
ANONYMOUS_MARKERS = (
    "sources said", "sources told", "sources say", "a source", "two sources", "three sources", "sources familiar", "people familiar",
    "person familiar", "people briefed", "person briefed", "people close to", "person close to", "officials said", "official said",
    "officials told", "on condition of anonymity", "speaking on condition", "declined to be named", "did not want to be named",
    "asked not to be named", "wished to remain", "anonymity", "insiders", "an insider", "a senior official", "people with knowledge",
)
CASCADE_MARKERS = ("according to", "reported", "cited", " per ", "wrote", "citing")
# End of fixed values.

REGISTRY = {name: canonical for canonical, names in ALIASES.items() for name in names}


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a key in a small fixed table; null if it is not there."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _any_of(text: Column, needles) -> Column:
    """Whether any needle occurs in the text, as one pattern."""
    quoted = "|".join(r"\Q" + n + r"\E" for n in needles)
    return text.rlike(quoted)


def host_of(c: Column | str) -> Column:
    """The host of a URL or bare host, lower case, without www."""
    bare = F.regexp_replace(F.lower(F.trim(_text(c))), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[/?#].*$", ""), r"^(?:[^@]*@)?(?:www\.)?|:\d+$", "")


def is_domain(c: Column | str) -> Column:
    return F.trim(_text(c)).rlike(r"(?i)^(?:[a-z0-9-]+\.)+[a-z]{2,}$")


def normal_domain(c: Column | str) -> Column:
    """A domain without scheme, path and generic leading labels; two labels always stay."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(_text(c)), "(?i)^https?://", ""), "/.*$", ""))
    return F.regexp_replace(bare, r"^(?:(?:www|m|mobile|amp|news|en|int)\.(?=[^.]*\.))+", "")


def normal_name(c: Column | str) -> Column:
    """An outlet's name without one leading article, one trailing generic word, punctuation and case."""
    s = F.regexp_replace(F.lower(F.trim(_text(c))), r"^(the|le|la|les|el|los|las|der|die|das|de|het)\s+", "")
    s = F.regexp_replace(s, r"(?<=\S)\s+(news\s+agency|news\s+service|media\s+group|media|group|network|online|digital|wire|international|agency)$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[.,'\"!?;:()\[\]{}<>]", " "), r"\s+", " "))


def canonical_source(c: Column | str) -> Column:
    """The canonical id of a source however it is written; an unknown one is its own normal form."""
    raw = F.lower(F.trim(_text(c)))
    domain, name = normal_domain(c), normal_name(c)
    site = raw.rlike("^https?://") | is_domain(c)
    return F.coalesce(
        lookup(REGISTRY, raw),
        F.when(site, F.coalesce(lookup(REGISTRY, domain), domain)).otherwise(F.coalesce(lookup(REGISTRY, name), F.nullif(name, F.lit("")), raw)),
    )


def source_country(c: Column | str) -> Column:
    """Country by the longest known suffix of a source; '' if none."""
    s = F.lower(F.trim(_text(c)))
    labels = F.split(s, r"\.")
    two, one = F.array_join(F.slice(labels, -2, 2), "."), F.element_at(labels, -1)
    return F.coalesce(F.when(F.size(labels) >= 2, lookup(SOURCE_SUFFIXES, two)), lookup(SOURCE_SUFFIXES, one), F.lit(""))


def archive_country(c: Column | str) -> Column:
    """Country by a domain's last two labels, then its last one; the suffix itself is no domain."""
    labels = F.split(_text(c), r"\.")
    two, one = F.array_join(F.slice(labels, -2, 2), "."), F.element_at(labels, -1)
    return F.coalesce(F.when(F.size(labels) > 2, lookup(ARCHIVE_SUFFIXES, two)), F.when(F.size(labels) > 1, lookup(ARCHIVE_SUFFIXES, one)), F.lit(""))


def language_code(c: Column | str) -> Column:
    """Two-letter code of the first language of a comma list."""
    first = F.lower(F.trim(F.get(F.split(_text(c), ","), 0)))
    return F.when(first == "", "").otherwise(F.coalesce(lookup(LANGUAGE_3_TO_2, first), F.substring(first, 1, 2)))


def language_country(c: Column | str) -> Column:
    """Country that a language other than English points to; '' if none."""
    return F.coalesce(lookup(LANGUAGE_COUNTRY, F.substring(F.lower(_text(c)), 1, 2)), F.lit(""))


def is_english(c: Column | str, strict: bool = False) -> Column:
    """Blank or English; strict takes the first two letters only."""
    s = F.lower(F.trim(_text(c)))
    return F.substring(s, 1, 2).isin("", "en") if strict else (s == "") | s.startswith("en")


def is_hard_rejected(c: Column | str) -> Column:
    """A domain that is no news outlet, or below one."""
    d = F.trim(F.regexp_replace(F.lower(_text(c)), r"^www\.", ""))
    return d.rlike(r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in HARD_REJECTED) + ")$")


def is_primary_source(c: Column | str) -> Column:
    """A source that issues what it reports: by name, by a gov or mil label, or by the end of its domain."""
    s = F.lower(_text(c))
    ends = "(" + "|".join(d.replace(".", r"\.") for d in PRIMARY_DOMAINS) + ")$"
    return _any_of(s, PRIMARY_MARKERS) | F.arrays_overlap(F.split(s, r"\."), F.array(F.lit("gov"), F.lit("mil"))) | s.rlike(ends)


def is_primary_name(c: Column | str) -> Column:
    """The narrower test of the source ratings: by name only."""
    return _any_of(F.lower(_text(c)), PRIMARY_NAMES)


def has_provenance(c: Column | str) -> Column:
    return _any_of(F.lower(_text(c)), PROVENANCE_MARKERS)


def is_anonymous(c: Column | str) -> Column:
    return _any_of(F.lower(_text(c)), ANONYMOUS_MARKERS)


def has_cascade_marker(body: Column | str) -> Column:
    """Whether a body attributes something to someone."""
    return _any_of(F.lower(_text(body)), CASCADE_MARKERS)


def cites(body: Column, tokens: Column) -> Column:
    """Whether a body attributes what it says to a source with these significant tokens."""
    return F.transform(F.array(F.lower(_text(body))), lambda low: _any_of(low, CASCADE_MARKERS) & F.exists(tokens, lambda t: low.contains(t)))[0]


def attribution_weight(body: Column, source: Column) -> Column:
    """1 for a primary or named source, 0.6 for an anonymous one, 0.3 for none."""
    return F.when(is_primary_source(source), 1.0).when(~has_provenance(body), 0.3).when(is_anonymous(body), 0.6).otherwise(1.0)
