"""URL filter: rules by host and path, and logistic regression on hashed character n-grams for what no rule fits."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules in force, as (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

# A small labelled table of hosts and paths, made up from the usual categories of block and allow lists
# without looking at any table of pages. Names are invented; what tells is the words in them.
BLOCKED = """
grand-royal-casino.net/bonus/welcome  www.spin-slots-online.com/slots/free-spins  casinoluckynight.io/play/roulette  bestpokerrooms.net/texas-holdem/bonus
betting-tips-today.info/odds/football  www.bet-and-win-now.com/sports/live-betting  jackpot-lottery.club/win/jackpot  bingo-bonus-codes.co/bonus
online-gambling-guide.biz/casino/reviews  vegas-slots.example.net/jackpot  sportsbook-odds.com/betting/lines  highroller-blackjack.net/tables
hot-adult-videos.xxx/videos/hd  www.free-porn-clips.net/categories/amateur  livesexcams.tv/webcam/girls  nude-models.club/gallery/nude  xxx-movies.org/watch/xxx
adult-dating-tonight.com/hookup/local  sexy-escorts.example.org/city/escorts  erotic-stories-xxx.net/stories  pornhost.example.com/embed/porn  camgirls-live.net/chat/sex
cheap-pills-pharmacy.ru/buy/viagra  www.buy-cialis-online.biz/order/cialis  discount-meds-no-prescription.com/tramadol  weightloss-miracle-pills.net/buy-now
canadian-pharmacy-rx.example.net/viagra/cheap  steroids-shop.biz/order/anabolic  slimming-pills.info/free-trial  pharma-cheap-rx.com/levitra
warez-download-crack.net/keygen/full-version  serial-keys-free.org/crack/office  www.cracked-software.to/download/keygen  torrent-movies-free.net/torrent/720p
nulled-scripts.cc/nulled/themes  free-movie-streams.to/watch/full-movie  apk-mod-hack.net/mod/unlimited-coins  piratemusic.example.org/mp3/download-free
ads.trackingpixel.net/click?id=1  adserver.popunder.com/banner/728x90  click.affiliate-redirect.net/track/offer  banners.ad-exchange.biz/adserve/impression
pixel.retarget-ads.com/track.gif  pop.adnetwork.example.net/popup/ads  doubleads.example.com/adclick  tracker.spyware-toolbar.net/install/exe
secure-login-verify-account.tk/paypal/signin  account-update-alert.ml/bank/verify  free-gift-card-winner.info/claim/prize  www.you-won-iphone.club/prize/claim
verify-wallet-seed.io/wallet/recover  appleid-unlock-alert.ga/signin/verify  lottery-winner-notice.cf/claim  survey-rewards-free.net/claim/giftcard
fast-payday-loans.biz/apply/bad-credit  instant-cash-loan.net/payday/apply  double-your-bitcoin.io/invest/profit  forex-robot-profit.com/get-rich  crypto-giveaway.cc/send/double
make-money-fast.example.net/earn/home  quick-loans-no-credit.info/cash  binary-options-signals.net/profit
cheap-replica-watches.cn/rolex/replica  fake-designer-bags.biz/louis/replica  seo-backlinks-cheap.net/buy/backlinks  instagram-followers-buy.com/buy/followers
hack-facebook-password.net/hack/account  ddos-booter.cc/stresser  malware-dropper.ru/payload.exe  keylogger-download.net/exe/setup  spam-mailer.biz/bulk/email
"""
ALLOWED = """
www.riverside-university.edu/admissions/undergraduate  physics.northfield.edu/research/papers  library.oakridge.edu/catalogue/search  www.hillcollege.ac.uk/courses/history
open-courses.example.org/lectures/algebra  mathforum.net/questions/proof  www.science-journal.org/articles/2021/cells  archive.biology-review.org/issue/12
www.citynewsdaily.com/politics/2022/05/election  morning-post.co.uk/weather/forecast  regional-herald.com/sports/football/results  www.radio-seven.de/nachrichten/heute
lemonde-local.fr/culture/theatre  diario-del-sur.es/economia/empleo  gazette.example.com/opinion/letters  worldreport.net/asia/business
www.health.state.gov/vaccines/schedule  parliament.gov.uk/bills/2020  www.stadt-neuburg.de/rathaus/formulare  mairie-saintpaul.fr/services/ecoles  ayuntamiento-villa.es/tramites
tax.service.gov/forms/2023  courts.example.gov/opinions  census.example.org/data/tables
en.encyclopedia-free.org/wiki/Photosynthesis  de.wissensbuch.org/artikel/Geschichte  dictionary-words.com/define/gentle  maps.openatlas.org/country/peru  www.worldfacts.net/rivers
docs.python-tools.io/en/latest/install.html  developer.webframe.org/reference/http/headers  github-mirror.example.net/project/readme  stackhelp.example.com/questions/4821/sort-list
linux-handbook.org/manual/filesystem  database-notes.net/sql/joins  blog.codecraft.dev/2021/testing  packages.debforge.org/stable/libs  api.weatherdata.io/v2/docs
www.grandmas-recipes.com/soup/tomato-basil  kochbuch.example.de/rezepte/apfelkuchen  cuisine-maison.fr/recettes/tarte  vegan-kitchen.net/dinner/lentils  bread-baker.org/sourdough/starter
gardenclub.org/plants/roses  birdwatch.example.net/species/heron  hiking-trails.co/alps/routes  www.cyclingmap.eu/tours/rhine  camping-guide.com/lakes  fishing-report.net/trout
travel-notes.com/italy/rome/museums  www.railtimes.eu/timetable/berlin  hotel-lindenhof.at/zimmer/preise  island-ferries.gr/routes  backpackers.example.org/peru/cusco
museum-of-art.org/exhibitions/current  www.philharmonic-hall.com/concerts/season  poetry-pages.net/authors/dickinson  filmreview.example.com/drama/2019  booknook.co/novels/review
chess-club.org/openings/sicilian  boardgames-forum.net/topic/1290  www.local-theatre.org.uk/tickets/plays  piano-lessons.net/beginner/scales  photo-journal.org/portraits
hospital-stmary.org/departments/cardiology  nutrition-advice.org/vitamins/iron  www.dentist-family.com/appointments  mentalhealth.example.org/anxiety/help  firstaid.net/burns
www.furniture-house.com/tables/oak  shoe-store.example.com/women/boots  books-and-more.de/warenkorb  bikeparts.nl/wheels/28-inch  teashop.co.uk/green/sencha  paperstore.com/office/pens
homeloans-bank.example.com/mortgage/rates  credit-union.org/accounts/savings  www.insurance-mutual.de/kontakt  pension-fund.eu/reports/annual  accounting-basics.net/ledger
elementary-school.k12.us/calendar/2023  kindergarten-sonne.de/aktuelles  scouts.example.org/camp/summer  parents-forum.net/thread/8831  animal-shelter.org/adopt/dogs
church-stjohn.org/services/sunday  volunteer-fire.org/join  farmers-market.net/stalls/honey  football-club.example.com/fixtures  tennis-verein.de/termine  yoga-studio.co/classes
carrepair-help.com/brakes/replace  electronics-lab.org/circuits/amplifier  telescope-guide.net/planets/saturn  geology.example.org/minerals/quartz  oceans.example.net/whales
forum.gardentalk.net/viewtopic?t=77  www.jobs-region.eu/stellen/pflege  realestate-lake.com/houses/garden  legal-help.org/tenants/rights  translate-words.eu/en/fr/house  m.timesnow.example.com/en/4821
"""
# Words that hosts and paths of each kind are made of, a line a category.
BLOCKED_WORDS = """
casino slots poker roulette blackjack jackpot bingo lottery lotto gambling betting bets bet odds sportsbook bookmaker wager baccarat craps vegas freespins
porn porno xxx sex sexy nude naked adult erotic hentai milf amateur webcam camgirl cams escort escorts hookup fetish tube18 boobs anal hardcore lesbian
viagra cialis levitra tramadol xanax pharmacy pills rx meds steroids slimming weightloss kamagra
warez crack cracked keygen serial nulled torrent torrents pirate rapidshare fullversion modapk cheats
adserver adserve ads adclick banner banners popup popunder doubleclick adnetwork adtrack tracker pixel affiliate clicktrack adsystem
phishing verify-account login-verify account-update unlock-account claim-prize giftcard winner free-iphone wallet-recover seed-phrase
payday loans quickcash badcredit getrich easymoney forex binary-options bitcoin-double giveaway moneyfast
replica rolex fake-watches backlinks buy-followers buy-likes hacktool ddos booter stresser malware keylogger spyware trojan botnet spam
"""
ALLOWED_WORDS = """
university college school academy campus faculty students library research science journal physics chemistry biology mathematics history geography lecture
news times post herald tribune gazette daily weather politics economy world radio zeitung nachrichten journal-du presse diario noticias
government ministry council parliament courts census taxes health hospital clinic doctor dentist vaccines medicine nutrition therapy
encyclopedia wiki dictionary atlas museum archive gallery theatre concert orchestra poetry novel books literature film cinema drama
docs developer software python java linux database compiler server github code forum questions answers tutorial reference packages
recipes kitchen cooking bakery garden flowers birds forest fishing hiking camping travel hotel island mountain railway flights beach
family children parents kindergarten church volunteer farm market football tennis chess cycling yoga running swimming stadium
furniture shoes clothes bicycle cars repair electronics camera telescope geology ocean energy engine tools paper office jobs houses
bank savings insurance pension mortgage accounting stocks invoice credit-union lawyer notary
rezepte kochbuch schule gemeinde stadt verein bibliothek reise wetter wirtschaft cuisine recettes mairie ecole voyage musique histoire escuela ciudad cocina viajes salud cultura
sussex essex middlesex alphabet diabetes tibet better between betterment adapt address download uploads canals analysis analytics assassin classics passport titles
"""
# What both kinds of hosts are called besides, so that it tells nothing.
AFFIXES = "online hub world zone club best my the top free live city stars party 24 365 888 central direct now land house base net web portal pro guide shop group one".split()
ENDINGS = "com net org info io co biz de fr es eu co.uk".split()


def made_of(words: str, forms: int = 3) -> list[str]:
    """Urls without a scheme, ``forms`` of each word: with an affix behind, before, and two words of a category with a path."""
    found = []
    for line in words.strip().splitlines():
        own = line.split()
        for i, word in enumerate(own):
            for k in range(forms):
                affix, ending = AFFIXES[(7 * len(found) + k) % len(AFFIXES)], ENDINGS[(5 * len(found) + k) % len(ENDINGS)]
                beside, path = own[(i + 1 + k) % len(own)], own[(i + 3 + k) % len(own)]
                host = (f"www.{word}{affix}.{ending}/", f"{affix}{word}.{ending}/", f"{word}-{beside}.{ending}/{path}")[k % 3]
                found.append(host)
    return found


#: 1 is to be blocked.
LABELLED = tuple((u, label) for label, table, words in ((1, BLOCKED, BLOCKED_WORDS), (0, ALLOWED, ALLOWED_WORDS)) for u in [*table.split(), *made_of(words)])


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty for null or where there is no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none does) and its verdict. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # longer ones are put around shorter ones
        at = text.index("/") if "/" in text else len(text)
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str, dims: int, sizes: Sequence[int] = (3, 4, 5)) -> np.ndarray:
    """Hashed places of the character n-grams of a host, without ``www.`` before it, and a path, each kept apart from the other."""
    found = set()
    for kind, text in (("h", f"^{host.removeprefix('www.')}$"), ("p", f"^{path.lower()}$")):
        for n in sizes:
            found.update(xxhash.xxh3_64_intdigest(kind + text[i : i + n]) % dims for i in range(len(text) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def train(labelled: Sequence[tuple[str, int]] = LABELLED, dims: int = 1 << 16, steps: int = 2000, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights of the logistic regression, the bias last, by full gradient steps from zero, so always the same."""
    cut = [re.match(r"([^/?#]*)([^?#]*)", u).groups() for u, _ in labelled]
    rows = [features(host.lower(), path, dims) for host, path in cut]
    y, w = np.array([k for _, k in labelled], float), np.zeros(dims + 1)
    lengths = np.array([len(r) for r in rows])
    place, scale = np.concatenate(rows), 1 / np.sqrt(lengths)
    starts = np.cumsum(lengths) - lengths
    for _ in range(steps):
        z = np.add.reduceat(w[place], starts) * scale + w[-1]
        gap = 1 / (1 + np.exp(-z)) - y
        g = decay * w
        g[:-1] += np.bincount(place, np.repeat(gap * scale * 10 / len(rows), lengths), dims)
        g[-1] += gap.mean()
        w -= rate * g
    return w


def _scorer(weights: np.ndarray):
    dims = len(weights) - 1

    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            out: list[float | None] = []
            for h, p in zip(hosts, paths, strict=True):
                f = features(h, p, dims) if h is not None else ()
                out.append(1 / (1 + np.exp(-(weights[f].sum() / np.sqrt(len(f)) + weights[-1]))) if len(f) else None)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(score, "double")


def filter_urls(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES,
    labelled: Sequence[tuple[str, int]] = LABELLED, dims: int = 1 << 16,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row for each row of ``pages``.

    The longest rule that fits decides; else the regression does, blocking at a score of 0.5 or more. The model is
    trained on ``labelled`` (host and path, 0 or 1) on the driver; its size is ``dims`` numbers whatever the input. Only
    urls that no rule decides are scored; score is null for the others.

    A null url, or one without ``://``, has empty host and path, fits no rule, has nothing that tells against it and is
    allowed, without a score. Very long urls are scored whole. Ids may be null or repeat, and repeated rows are
    repeated; an empty table gives an empty table; other columns are not read. No shuffle.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, decided = rule_for(F.col("host"), F.col("path"), rules)
    told = rows.withColumn("rule", rule).withColumn("by_rule", decided)
    open_host = F.when(F.col("by_rule").isNull() & ((F.col("host") != "") | (F.col("path") != "")), F.col("host"))
    judged = told.withColumn("score", _scorer(train(labelled, dims))(open_host, F.col("path")))
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
