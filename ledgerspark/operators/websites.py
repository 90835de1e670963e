"""C11: subscription merchant -> website.

The dimension is a fixed list (58 sites, 57 alias lists) whose *order* matters.
Each distinct merchant is looked up once: its name, its words and its substrings of
the lengths that occur in the list are hash-joined to the list's patterns (a few
thousand constant rows, broadcast), and the smallest (rule, place) wins. No pattern is
tried against a merchant that does not hold it. Rules, in order:

1. exact match of the upper-cased, stripped merchant;
2. the first site (in list order) where any word of the site name is a
   substring of the merchant, or any merchant word is a substring of the
   site name;
3. the first alias list (in order) with an alias contained in the merchant;
   its site's URL -- NULL when that key is not a site (and matching stops);
4. otherwise NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Known subscription sites, in the reference's order.
# ---------------------------------------------------------------------------
SUBSCRIPTION_WEBSITES = [
    ("NETFLIX", "https://netflix.com"),
    ("SPOTIFY", "https://spotify.com"),
    ("AMAZON PRIME", "https://amazon.com/prime"),
    ("DISNEY", "https://disneyplus.com"),
    ("HULU", "https://hulu.com"),
    ("APPLE MUSIC", "https://music.apple.com"),
    ("YOUTUBE PREMIUM", "https://youtube.com/premium"),
    ("HBO MAX", "https://hbomax.com"),
    ("PARAMOUNT", "https://paramountplus.com"),
    ("PEACOCK", "https://peacocktv.com"),
    ("ADOBE", "https://adobe.com"),
    ("MICROSOFT 365", "https://microsoft.com/microsoft-365"),
    ("GOOGLE DRIVE", "https://drive.google.com"),
    ("DROPBOX", "https://dropbox.com"),
    ("NOTION", "https://notion.so"),
    ("SLACK", "https://slack.com"),
    ("ZOOM", "https://zoom.us"),
    ("CANVA", "https://canva.com"),
    ("FIGMA", "https://figma.com"),
    ("XBOX", "https://xbox.com"),
    ("PLAYSTATION", "https://playstation.com"),
    ("STEAM", "https://store.steampowered.com"),
    ("NINTENDO", "https://nintendo.com"),
    ("EPIC GAMES", "https://epicgames.com"),
    ("PELOTON", "https://onepeloton.com"),
    ("CLASSPASS", "https://classpass.com"),
    ("MYFITNESSPAL", "https://myfitnesspal.com"),
    ("HEADSPACE", "https://headspace.com"),
    ("CALM", "https://calm.com"),
    ("UBER EATS", "https://ubereats.com"),
    ("DOORDASH", "https://doordash.com"),
    ("GRUBHUB", "https://grubhub.com"),
    ("INSTACART", "https://instacart.com"),
    ("HELLOFRESH", "https://hellofresh.com"),
    ("BLUE APRON", "https://blueapron.com"),
    ("AWS", "https://aws.amazon.com"),
    ("GOOGLE CLOUD", "https://cloud.google.com"),
    ("DIGITALOCEAN", "https://digitalocean.com"),
    ("HEROKU", "https://heroku.com"),
    ("NETLIFY", "https://netlify.com"),
    ("NEW YORK TIMES", "https://nytimes.com"),
    ("WALL STREET JOURNAL", "https://wsj.com"),
    ("THE ATLANTIC", "https://theatlantic.com"),
    ("MEDIUM", "https://medium.com"),
    ("SUBSTACK", "https://substack.com"),
    ("ICLOUD", "https://icloud.com"),
    ("ONEDRIVE", "https://onedrive.live.com"),
    ("LASTPASS", "https://lastpass.com"),
    ("1PASSWORD", "https://1password.com"),
    ("GRAMMARLY", "https://grammarly.com"),
    ("LINKEDIN", "https://linkedin.com/premium"),
    ("CRUNCHYROLL", "https://crunchyroll.com"),
    ("PATREON", "https://patreon.com"),
    ("ONLYFANS", "https://onlyfans.com"),
    ("TWITCH", "https://twitch.tv"),
    ("DISCORD", "https://discord.com"),
    ("TELEGRAM", "https://telegram.org"),
    ("SIGNAL", "https://signal.org"),
]

# Alias lists, in the reference's order. Keys that are not
# sites above (AMAZON, APPLE, GOOGLE, MICROSOFT, UBER, BLUEAPRON, YOUTUBE)
# resolve to NULL.
WEBSITE_ALIASES = [
    ("NETFLIX", ["NETFLIX", "NETFLIX.COM"]),
    ("SPOTIFY", ["SPOTIFY", "SPOTIFY.COM"]),
    ("AMAZON", ["AMAZON", "AMAZON.COM", "AMAZON PRIME", "PRIME"]),
    ("DISNEY", ["DISNEY", "DISNEY+", "DISNEY PLUS"]),
    ("APPLE", ["APPLE", "APPLE MUSIC", "APPLE.COM"]),
    ("GOOGLE", ["GOOGLE", "GOOGLE DRIVE", "GOOGLE.COM"]),
    ("MICROSOFT", ["MICROSOFT", "MSFT", "OFFICE 365", "MICROSOFT 365"]),
    ("ADOBE", ["ADOBE", "ADOBE.COM"]),
    ("XBOX", ["XBOX", "XBOX LIVE"]),
    ("PLAYSTATION", ["PLAYSTATION", "PSN", "PLAYSTATION NETWORK"]),
    ("STEAM", ["STEAM", "STEAM.COM"]),
    ("UBER", ["UBER", "UBER EATS"]),
    ("DOORDASH", ["DOORDASH", "DOOR DASH"]),
    ("GRUBHUB", ["GRUBHUB", "GRUB HUB"]),
    ("INSTACART", ["INSTACART", "INSTA CART"]),
    ("HELLOFRESH", ["HELLOFRESH", "HELLO FRESH"]),
    ("BLUEAPRON", ["BLUEAPRON", "BLUE APRON"]),
    ("PELOTON", ["PELOTON", "PELOTON.COM"]),
    ("CLASSPASS", ["CLASSPASS", "CLASS PASS"]),
    ("MYFITNESSPAL", ["MYFITNESSPAL", "MY FITNESS PAL"]),
    ("HEADSPACE", ["HEADSPACE", "HEAD SPACE"]),
    ("NEW YORK TIMES", ["NYTIMES", "NEW YORK TIMES", "NY TIMES"]),
    ("WALL STREET JOURNAL", ["WSJ", "WALL STREET JOURNAL"]),
    ("THE ATLANTIC", ["ATLANTIC", "THE ATLANTIC"]),
    ("SUBSTACK", ["SUBSTACK", "SUB STACK"]),
    ("ONLYFANS", ["ONLYFANS", "ONLY FANS"]),
    ("CRUNCHYROLL", ["CRUNCHYROLL", "CRUNCHY ROLL"]),
    ("PATREON", ["PATREON", "PATREON.COM"]),
    ("TWITCH", ["TWITCH", "TWITCH.TV"]),
    ("DISCORD", ["DISCORD", "DISCORD.COM"]),
    ("TELEGRAM", ["TELEGRAM", "TELEGRAM.ORG"]),
    ("SIGNAL", ["SIGNAL", "SIGNAL.ORG"]),
    ("GRAMMARLY", ["GRAMMARLY", "GRAMMARLY.COM"]),
    ("LINKEDIN", ["LINKEDIN", "LINKEDIN.COM"]),
    ("LASTPASS", ["LASTPASS", "LAST PASS"]),
    ("1PASSWORD", ["1PASSWORD", "1 PASSWORD"]),
    ("ICLOUD", ["ICLOUD", "I CLOUD"]),
    ("ONEDRIVE", ["ONEDRIVE", "ONE DRIVE"]),
    ("AWS", ["AWS", "AMAZON WEB SERVICES"]),
    ("GOOGLE CLOUD", ["GOOGLE CLOUD", "GCP"]),
    ("DIGITALOCEAN", ["DIGITALOCEAN", "DIGITAL OCEAN"]),
    ("HEROKU", ["HEROKU", "HEROKU.COM"]),
    ("NETLIFY", ["NETLIFY", "NETLIFY.COM"]),
    ("DROPBOX", ["DROPBOX", "DROPBOX.COM"]),
    ("NOTION", ["NOTION", "NOTION.SO"]),
    ("SLACK", ["SLACK", "SLACK.COM"]),
    ("ZOOM", ["ZOOM", "ZOOM.US"]),
    ("CANVA", ["CANVA", "CANVA.COM"]),
    ("FIGMA", ["FIGMA", "FIGMA.COM"]),
    ("EPIC GAMES", ["EPIC", "EPIC GAMES"]),
    ("NINTENDO", ["NINTENDO", "NINTENDO.COM"]),
    ("HULU", ["HULU", "HULU.COM"]),
    ("HBO MAX", ["HBO", "HBO MAX", "MAX"]),
    ("PARAMOUNT", ["PARAMOUNT", "PARAMOUNT PLUS"]),
    ("PEACOCK", ["PEACOCK", "PEACOCK TV"]),
    ("YOUTUBE", ["YOUTUBE", "YOUTUBE PREMIUM"]),
    ("MEDIUM", ["MEDIUM", "MEDIUM.COM"]),
]


def patterns() -> list[tuple[str, str, int, int, str | None]]:
    """(kind, pattern, rule, place, url): a merchant's name, a word of it or a part of it
    that equals ``pattern`` is a hit of ``rule``; ``place`` is the entry's in its list."""
    out = set()
    url_of = dict(SUBSCRIPTION_WEBSITES)
    for place, (known, url) in enumerate(SUBSCRIPTION_WEBSITES):
        out.add(("name", known, 1, place, url))
        for word in known.split():
            out.add(("part", word, 2, place, url))
            # a merchant's word may be any piece of the known name
            out |= {("word", word[i:j], 2, place, url) for i in range(len(word)) for j in range(i + 1, len(word) + 1)}
    for place, (known, aliases) in enumerate(WEBSITE_ALIASES):
        out |= {("part", alias, 3, place, url_of.get(known)) for alias in aliases}
    return sorted(out, key=str)


def _parts(name: Column, lengths: list[int]) -> Column:
    """Every substring of these lengths."""
    def of(n):
        starts = F.sequence(F.lit(1), F.char_length(name) - (n - 1))
        return F.when(F.char_length(name) >= n, F.transform(starts, lambda i: F.substr(name, i, F.lit(n)))) \
                .otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*map(of, lengths)))


def websites(merchants: DataFrame, merchant_col: str = "merchant") -> DataFrame:
    """(merchant, website) of the distinct merchants that a rule finds; the website is
    NULL where an alias of no known site was first."""
    known = patterns()
    lengths = sorted({len(p) for kind, p, *_ in known if kind == "part"})
    # constant rows; their number depends on the fixed lists only
    dim = F.broadcast(merchants.sparkSession.createDataFrame(known, "kind string, pattern string, rule int, place int, url string"))
    m = merchants.select(F.col(merchant_col).alias("merchant")).filter("merchant <> ''").distinct()
    name = F.upper(F.regexp_replace("merchant", r"^\s+|\s+$", ""))

    def keys(kind, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("pattern")))
    held = F.concat(keys("name", F.array("_name")), keys("word", F.split("_name", r"\s+")),
                    keys("part", F.array_distinct(_parts(F.col("_name"), lengths))))
    return (m.withColumn("_name", name).select("merchant", F.explode(held).alias("k")).select("merchant", "k.*")
            .join(dim, ["kind", "pattern"])
            .groupBy("merchant").agg(F.min(F.struct("rule", "place", "url"))["url"].alias("website")))


def attach_website(subs: DataFrame, merchant_col: str = "merchant") -> DataFrame:
    """C11: ``subs`` with its merchants' ``website``, NULL where no rule hits."""
    found = websites(subs, merchant_col).withColumnRenamed("merchant", "_merchant")
    return subs.join(found, F.col(merchant_col) == F.col("_merchant"), "left").drop("_merchant")
