"""URL filter: host rules first, then an Aho-Corasick count of weighted vocabulary terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

# The vocabulary of the filter. One strict term rejects a URL; a soft term needs company.
STRICT = (
    "casino", "porn", "porno", "sex", "xxx", "hentai", "viagra", "cialis", "malware", "phishing", "warez",
    "spielothek", "sexe", "sexo", "porntube", "onlinecasino",
)
SOFT = (
    "ad", "ads", "adult", "banner", "bet", "bets", "betting", "bonus", "cheap", "click", "crack", "dating", "deal",
    "deals", "discount", "download", "escort", "farm", "free", "gambling", "hack", "hot", "jackpot", "keygen", "loan",
    "loans", "lottery", "nude", "pharmacy", "pill", "pills", "poker", "promo", "slots", "spam", "torrent", "track",
    "tracker", "tracking", "win", "winner", "x", "gratis", "gratuit", "kostenlos", "billig", "gewinn", "wetten",
    "apuestas", "barato", "paris-sportifs", "premio",
)
SOFT_LIMIT = 2  # distinct soft terms that reject

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own.
Rule = tuple[str, str, str]

TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text: str) -> str:
    """A-Z as a-z, everything else unchanged."""
    return text.translate(TO_LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host after the first ``://`` in lower case, and path; both empty without one."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return lower(host), slash + path


class Rules:
    """The longest rule for a host and path; looked up by the host's parent domains."""

    def __init__(self, rules: Sequence[Rule]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(lower(host), []).append((path, verdict))

    def fit(self, host: str, path: str) -> tuple[str, str] | None:
        best, rank = None, (-1, -1)
        domain = host
        while domain:
            for start, verdict in self.by_host.get(domain, ()):
                here = (len(domain) + len(start), len(domain))
                if path.startswith(start) and here > rank:
                    best, rank = (domain + start, verdict), here
            domain = domain.partition(".")[2]
        return best


class Vocabulary:
    """Occurrences of strict and soft terms in one pass over a URL.

    A term counts only between boundaries: the characters beside it are neither
    ASCII letters or digits nor beyond ASCII. Overlapping terms all count.
    """

    def __init__(self, strict: Sequence[str], soft: Sequence[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        terms = {lower(t): False for t in soft} | {lower(t): True for t in strict}
        for term, is_strict in terms.items():
            if not term:
                raise ValueError("a term must not be empty")
            self.automaton.add_word(term, (term, is_strict))
        self.any = bool(terms)
        if self.any:
            self.automaton.make_automaton()

    @staticmethod
    def _inner(c: str) -> bool:
        return "a" <= c <= "z" or "0" <= c <= "9" or c > "\x7f"

    def count(self, url: str | None) -> tuple[int, int, int]:
        """Strict occurrences, soft occurrences, distinct soft terms."""
        if not url or not self.any:
            return 0, 0, 0
        text, n_strict, n_soft, seen = lower(url), 0, 0, set()
        for end, (term, is_strict) in self.automaton.iter(text):
            start = end - len(term) + 1
            if (start and self._inner(text[start - 1])) or (end + 1 < len(text) and self._inner(text[end + 1])):
                continue
            if is_strict:
                n_strict += 1
            else:
                n_soft += 1
                seen.add(term)
        return n_strict, n_soft, len(seen)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = (),
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = SOFT_LIMIT,
    id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, n_strict, n_soft, n_soft_terms``: one row per page.

    The longest fitting rule decides; without one a URL is blocked when it holds
    one strict term or ``soft_limit`` distinct soft ones, anywhere in it. Equal
    lengths: the rule of the longer host, then the one given first. A null URL
    and one without ``://`` have an empty host and path and no rule; a null or
    empty URL has no terms and is allowed. Repeated rows are judged alike, one
    row each; other columns of any name are ignored; an empty table gives an
    empty result. Rules and terms are parameters that travel with the function,
    so their size does not depend on the data. Only id and URL are read, and
    nothing is shuffled.
    """
    kind = dict(pages.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, terms = Rules(rules), Vocabulary(strict, soft)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                host, path = split_url(text)
                found = fits.fit(host, path)
                n_strict, n_soft, n_terms = terms.count(text)
                own = "block" if n_strict or n_terms >= soft_limit else "allow"
                rule, verdict = found or (None, own)
                rows.append((host, path, rule, verdict, n_strict, n_soft, n_terms))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array(c, pa.string()) for c in columns[:4]]
                + [pa.array(c, pa.int64()) for c in columns[4:]],
                names=["id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "n_soft_terms"],
            )

    schema = f"id {kind}, host string, path string, rule string, verdict string, n_strict long, n_soft long, n_soft_terms long"
    found = pages.select(pages[id].alias("id"), pages[url].cast("string").alias("url")).mapInArrow(run, schema)
    return found.withColumnRenamed("id", id)
