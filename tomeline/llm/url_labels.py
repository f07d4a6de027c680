"""A small labelled URL table: invented hosts and paths of unwanted and of ordinary sites, over many domains."""

from __future__ import annotations

import pandas as pd

# Words of unwanted and of ordinary sites' names, words beside them, domains and paths.
UNWANTED = (
    "casino", "poker", "jackpot", "roulette", "slots", "betting", "bets", "lottery", "gambling", "pills", "viagra", "pharmacy", "steroids", "payday", "loans",
    "replica", "adult", "warez", "keygen", "cracked", "torrents", "xxx", "porn", "escorts", "camgirls", "getrich", "freemoney", "clickbait", "spyware", "phishing", "weightloss", "spam", "tracker", "adserver", "linkfarm", "malware",
)
BESIDE_UNWANTED = ("win", "free", "cheap", "bonus", "vip", "best", "online", "fast", "easy", "now", "super", "deals")
ORDINARY = (
    "news", "daily", "herald", "gazette", "library", "museum", "university", "school", "college", "research", "science", "journal", "archive", "wiki", "manual",
    "support", "forum", "community", "recipes", "kitchen", "garden", "travel", "weather", "maps", "history", "music", "books", "theatre", "photo", "football",
    "hospital", "council", "parliament", "justice", "savings", "postal", "railway", "airport", "energy", "water", "nature", "birds", "maths", "physics", "biology",
    "language", "dictionary", "opendata", "software", "linux", "robotics", "chess", "cycling", "hiking", "pottery", "orchestra", "farming", "harbour", "bakery", "village",
)
BESIDE_ORDINARY = ("my", "the", "local", "national", "north", "river", "green", "old", "central", "free", "best", "online")
DOMAINS = ("com", "org", "net", "info", "de", "fr", "es", "eu", "co.uk", "example.com", "example.org", "example.net")
SYLLABLES = ("ta", "ri", "mo", "len", "the", "sor", "kin", "ven", "an", "dor", "est", "hil", "ber", "tion", "stra", "wen")  # of ordinary invented names
FRONT = ("", "www.", "m.", "blog.")
PATHS = ("/", "/en/1204", "/de/77.html", "/fr/9913/", "/es/42", "/2021/05/story", "/index.html", "/about", "/en/page/3", "/a/b/c")
UNWANTED_PATHS = ("/win-now", "/free-spins", "/buy-cheap", "/bonus")


def labelled_urls(variants: int = 12) -> pd.DataFrame:
    """``host, path, block``: every word with ``variants`` words beside it, and as many invented
    names as ordinary words; domains and paths are taken in turn, alike for both labels."""
    rows = []

    def add(n: int, name: str, block: int, path: str | None = None) -> None:
        rows.append((f"{FRONT[n * 7 % 9 % 4]}{name}.{DOMAINS[n * 5 % 11 % len(DOMAINS)] if n % 3 else DOMAINS[9 + n // 3 % 3]}", path or PATHS[n * 3 % len(PATHS)], block))

    for block, words, beside in ((1, UNWANTED, BESIDE_UNWANTED), (0, ORDINARY, BESIDE_ORDINARY)):
        for i, word in enumerate(words):
            for v in range(variants):
                other, mark = beside[(i + v) % len(beside)], "-" if v % 3 else ""
                name = (word, f"{word}{mark}{other}", f"{other}{mark}{word}")[v % 3]
                add(i * variants + v + i, name, block, UNWANTED_PATHS[i % len(UNWANTED_PATHS)] if block and v % 6 == 5 else None)
    for n in range(len(ORDINARY) * variants):
        parts = [SYLLABLES[(n * step + n // 16 + k) % 16] for k, step in enumerate((1, 5, 11))][: 2 + n % 2]
        add(n, "".join(parts), 0)
    return pd.DataFrame(rows, columns=["host", "path", "block"]).drop_duplicates(ignore_index=True)
