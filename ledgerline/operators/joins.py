"""Joins between the log tables.

Lookups are many-to-one: the looked-up side is first reduced to one row per
key with a map-side aggregate, so a join never multiplies rows. Which side is
small enough to broadcast is left to the planner, which checks its size; a hot
key on the many side is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as X
from ledgerline.operators import filters

# Services that count as mailboxes.
MAIL_SERVICES = ("outlook", "outlook.com", "gmail", "tutanota", "protonmail", "hotmail")


def persona_summary(personas: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every persona with its number of accounts, 0 if none."""
    per = accounts.groupBy(F.col("persona").alias("name")).agg(
        F.count(F.lit(1)).alias("account_count")
    )
    return personas.join(per, "name", "left").fillna(0, ["account_count"])


def is_mail() -> Column:
    """Active mailbox accounts."""
    return F.lower("service").isin(*MAIL_SERVICES) & (F.col("status") == "active")


def primary_email(accounts: DataFrame) -> DataFrame:
    """Email of the first active mail account per persona."""
    return accounts.where(is_mail()).groupBy("persona").agg(
        F.min(F.struct("created_at", "id", "email")).getField("email").alias("primary_email")
    )


def orphans(child: DataFrame, parent: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Child rows whose key has no parent row; on = (child column, parent column)."""
    child_col, parent_col = on
    keys = parent.select(F.col(parent_col).alias(child_col)).distinct()
    return child.join(keys, child_col, "left_anti")


def flag_known(rows: DataFrame, base: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Add whether the base holds the row's key, in one pass; a key with a NULL is not held."""
    known = base.select(*keys).distinct().withColumn(flag, F.lit(True))
    return rows.join(known, [*keys], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def split_conflicts(
    new: DataFrame, base: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(rows free to insert, rows whose key already exists); ``flag_known`` gives both in one table."""
    flagged = flag_known(new, base, keys, "__taken")
    return flagged.where(~F.col("__taken")).drop("__taken"), flagged.where("__taken").drop("__taken")


# --- URLs to recipes ---


def match_domains(domains: DataFrame, flows: DataFrame) -> DataFrame:
    """One row per domain: match_tier, match_key, n_flows and the best flow.

    Exact matches win as a whole; the base domain is tried only when the exact
    domain has no flow. Best is the first by action (exact) or by domain and
    action (base).
    """
    known = flows.select("domain", "action", X.base_domain("domain").alias("base"))
    best = F.min(F.struct("domain", "action"))
    exact = known.groupBy("domain").agg(F.count(F.lit(1)).alias("__ne"), best.alias("__exact"))
    base = known.groupBy("base").agg(F.count(F.lit(1)).alias("__nb"), best.alias("__base"))
    found = (
        domains.select("domain", X.base_domain("domain").alias("base"))
        .join(exact, "domain", "left")
        .join(base, "base", "left")
    )
    named = F.col("domain") != ""
    is_exact = named & F.col("__ne").isNotNull()
    is_base = named & F.col("__ne").isNull() & F.col("__nb").isNotNull()
    pick = F.when(is_exact, F.col("__exact")).when(is_base, F.col("__base"))
    return found.select(
        "domain",
        F.when(is_exact, "exact").when(is_base, "base").otherwise("none").alias("match_tier"),
        F.when(is_exact, F.col("domain")).when(is_base, F.col("base")).alias("match_key"),
        F.when(is_exact, F.col("__ne"))
        .when(is_base, F.col("__nb"))
        .otherwise(0)
        .cast("bigint")
        .alias("n_flows"),
        pick["domain"].alias("flow_domain"),
        pick["action"].alias("flow_action"),
    )


def match_flows(urls: DataFrame, flows: DataFrame, url: str = "url") -> DataFrame:
    """URLs with their match. Matching runs once per distinct domain.

    The full list of a URL's flows is ``recipe_lists`` at its
    (match_tier, match_key); it is not repeated per URL.
    """
    keyed = urls.withColumn("domain", X.extract_domain(url))
    matches = match_domains(keyed.select("domain").distinct(), flows)
    return keyed.join(matches, "domain", "left")


def recipe_lists(matches: DataFrame, flows: DataFrame) -> DataFrame:
    """All flows behind each used (match_tier, match_key); two rows per flow at most."""
    used = matches.where(F.col("match_tier") != "none").select("match_tier", "match_key").distinct()
    slots = F.array(
        F.struct(F.lit("exact").alias("match_tier"), F.col("domain").alias("match_key")),
        F.struct(F.lit("base").alias("match_tier"), X.base_domain("domain").alias("match_key")),
    )
    listed = flows.withColumn("__slot", F.explode(slots)).select("__slot.*", *flows.columns)
    return listed.join(used, ["match_tier", "match_key"], "left_semi")


def flows_by_domain(flows: DataFrame) -> DataFrame:
    """Flows in domain, action order with the size of their domain group.

    The group is a run of sorted rows, not a collected list, so that a domain
    with very many flows spreads over several tasks.
    """
    sizes = flows.groupBy("domain").agg(F.count(F.lit(1)).alias("domain_flows"))
    return flows.join(sizes, "domain").orderBy("domain", "action")


# --- accounts ---


def login_urls(accounts: DataFrame, flows: DataFrame) -> DataFrame:
    """Where to log in: the saved login flow's first navigate URL, else the service host."""
    navigate = F.filter(
        "steps", lambda s: (s["action"] == "navigate") & F.coalesce(s["url"] != "", F.lit(False))
    )
    saved = flows.where(F.col("action") == "login").select(
        F.col("domain").alias("service"), F.get(navigate, F.lit(0))["url"].alias("__saved")
    )
    from_service = F.when(X.has_tld("service"), F.concat(F.lit("https://"), F.col("service")))
    return (
        accounts.join(saved, "service", "left")
        .withColumn("login_url", F.coalesce("__saved", from_service))
        .withColumn(
            "status_code",
            F.when(F.col("__saved").isNotNull(), "flow")
            .when(X.has_tld("service"), "service")
            .otherwise("no_tld"),
        )
        .drop("__saved")
    )


GRAM = 3


def find_account(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """First account of the persona whose service contains the asked name.

    An inverted index lists the q-grams of every distinct service of a persona, each once, so it grows with the
    length of a name and not with its square. A request goes to the list of its rarest q-gram, where the names are
    compared with it; names shorter than a q-gram go to lists of names by their single characters and pairs. A
    request that no name of its persona can hold meets no list at all.
    """
    asked = requests.select("persona", F.lower("service").alias("__needle")).distinct().where("__needle IS NOT NULL")
    services = accounts.groupBy("persona", F.lower("service").alias("__service")).agg(
        F.min(F.struct("created_at", "id", F.col("service").alias("account_service"))).alias("__a")
    )
    sizes = asked.select(F.least(F.length("__needle"), F.lit(GRAM)).alias("__q"), "persona").distinct()
    wanted = sizes.groupBy("persona").agg(F.collect_list("__q").alias("__sizes"))  # at most GRAM + 1 sizes
    index = (
        services.join(wanted, "persona")
        .withColumn("__q", F.explode("__sizes"))
        .withColumn("__gram", F.explode(_grams(F.col("__service"), F.col("__q"))))
        .select("persona", "__gram", "__service", "__a")
    )
    grams = asked.withColumn("__q", F.least(F.length("__needle"), F.lit(GRAM)))
    grams = grams.select("persona", "__needle", F.explode(_grams(F.col("__needle"), F.col("__q"))).alias("__gram"))
    lists = index.groupBy("persona", "__gram").agg(F.count(F.lit(1)).alias("__n"))
    rarest = (
        grams.join(lists, ["persona", "__gram"], "left")
        .groupBy("persona", "__needle")
        .agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__gram")).alias("__least"))
        .where("__least.n > 0")
        .select("persona", "__needle", F.col("__least.__gram").alias("__gram"))
    )
    found = (
        rarest.join(index, ["persona", "__gram"])
        .where(F.col("__service").contains(F.col("__needle")))
        .groupBy("persona", "__needle")
        .agg(F.min("__a").alias("__a"))
    )
    return (
        requests.withColumn("__needle", F.lower("service"))
        .join(found, ["persona", "__needle"], "left")
        .select(*requests.columns, F.col("__a.id").alias("account_id"), F.col("__a.account_service").alias("account_service"))
    )


def _grams(text: Column, size: Column) -> Column:
    """Distinct substrings of one size; the empty one for size 0, none of a text that is shorter."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - F.greatest(size, F.lit(1)) + 1))
    listed = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))
    return F.when(size == 0, F.array(F.lit(""))).otherwise(listed)


# --- page elements ---

BLOCK = 4_096
PAGE_PAIRS = 1 << 16


def match_elements(targets: DataFrame, elements: DataFrame) -> DataFrame:
    """First element, in document order, with a word of the description in one of its texts.

    On a page with few words and elements each word is looked for in each text. Pages on which that would be more
    than PAGE_PAIRS looks go another way: their distinct words become an Aho-Corasick automaton, which reads the texts
    of the page's elements once and gives the first element of every word, and descriptions take the smallest position
    of their words. Words are cut at white space; a null or empty description has none.
    """
    words = F.filter(F.split(F.lower("description"), r"\s+"), lambda w: w != "")
    asked = targets.select("page_id", "description").distinct().withColumn("__words", words)
    texts = [F.lower(F.coalesce(t, F.lit(""))) for t in ("text", "ariaLabel", "placeholder", "name")]
    offered = elements.select(
        "page_id", F.col("pos").cast("long").alias("pos"), F.array_join(F.array(*texts), "\n").alias("said")
    )
    counts = [
        asked.groupBy("page_id").agg(F.sum(F.size("__words")).alias("__w")),
        offered.groupBy("page_id").agg(F.count(F.lit(1)).alias("__e")),
    ]
    busy = counts[0].join(counts[1], "page_id").where(F.col("__w") * F.col("__e") > PAGE_PAIRS)
    if busy.isEmpty():
        best = _by_pairs(asked, offered)
    else:
        quiet = [df.join(busy.select("page_id"), "page_id", "left_anti") for df in (asked, offered)]
        rest = [df.join(busy.select("page_id"), "page_id", "left_semi") for df in (asked, offered)]
        best = _by_pairs(*quiet).unionByName(_by_automaton(*rest))
    place = elements.schema["pos"].dataType
    return targets.join(best, ["page_id", "description"], "left").select(*targets.columns, F.col("pos").cast(place).alias("pos"))


def _by_pairs(asked: DataFrame, offered: DataFrame) -> DataFrame:
    hit = F.exists("__words", lambda w: F.col("said").contains(w))
    return asked.join(offered, "page_id").where(hit).groupBy("page_id", "description").agg(F.min("pos").alias("pos"))


def _by_automaton(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """Words and elements of a page meet in blocks of about BLOCK of each: its texts are read once per block of words."""
    each = asked.select("page_id", "description", F.explode("__words").alias("word")).distinct()
    distinct_words = each.select("page_id", "word").distinct()
    sizes = [
        df.groupBy("page_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
        for df, name in ((distinct_words, "__w"), (offered, "__e"))
    ]
    met = sizes[0].join(sizes[1], "page_id")
    block = lambda key, parts: F.pmod(F.xxhash64(key), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    none = [F.lit(None).cast("long").alias("pos"), F.lit(0).alias("kind")]
    ours = distinct_words.join(met, "page_id").select(
        "page_id", block("word", "__w").alias("w"), every("__e").alias("e"), *none, F.col("word").alias("said")
    )
    theirs = offered.join(met, "page_id").select(
        "page_id", every("__w").alias("w"), block("pos", "__e").alias("e"), "pos", F.lit(1).alias("kind"), "said"
    )
    by = ["page_id", "w", "e"]
    groups = ours.unionByName(theirs).repartition(*by).sortWithinPartitions(*by, "kind")  # words first
    page = asked.schema["page_id"].dataType.simpleString()
    hits = groups.mapInArrow(_first_of_words, f"page_id {page}, word string, pos long")
    first = hits.groupBy("page_id", "word").agg(F.min("pos").alias("pos"))
    return each.join(first, ["page_id", "word"]).groupBy("page_id", "description").agg(F.min("pos").alias("pos"))


def _first_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest position of an element in whose texts each word occurs, group by group; a group's words come first."""
    group, words, automaton = None, [], None
    first: dict[str, int] = {}
    kind = pa.int64()

    def told(pages: list, found: list, places: list) -> pa.RecordBatch:
        arrays = [pa.array(pages, kind), pa.array(found, pa.string()), pa.array(places, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["page_id", "word", "pos"])

    pages, found, places = [], [], []

    def close() -> None:
        pages.extend([group[0]] * len(first) if group else [])
        found.extend(first)
        places.extend(first.values())

    for batch in batches:
        kind = batch.schema.field("page_id").type
        keys = zip(*[batch.column(n).to_pylist() for n in ("page_id", "w", "e")])
        rest = [batch.column(n).to_pylist() for n in ("pos", "kind", "said")]
        for key, pos, is_element, said in zip(keys, *rest):
            if key != group:
                close()
                group, words, automaton, first = key, [], None, {}
            if not is_element:
                words.append(said)
                continue
            automaton = automaton or Automaton(words)
            if pos is not None:
                for word in automaton.words_in(said):
                    first[word] = min(first.get(word, pos), pos)
        yield told(pages, found, places)
        pages, found, places = [], [], []
    close()
    yield told(pages, found, places)


class Automaton:
    """Aho-Corasick: which of some words occur in a text, in one reading of it."""

    def __init__(self, words: list[str]):
        self.steps: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        for word in words:
            at = 0
            for sign in word:
                after = self.steps[at].get(sign)
                if after is None:
                    after = self.steps[at][sign] = len(self.steps)
                    self.steps.append({})
                    self.word.append(None)
                at = after
            self.word[at] = word
        self.fall = [0] * len(self.steps)  # longest proper suffix that begins a word
        self.next = [0] * len(self.steps)  # nearest suffix that is a word; 0: none
        queue = list(self.steps[0].values())
        for at in queue:
            for sign, after in self.steps[at].items():
                fall = self.fall[at]
                while fall and sign not in self.steps[fall]:
                    fall = self.fall[fall]
                self.fall[after] = fall = self.steps[fall].get(sign, 0)
                self.next[after] = fall if self.word[fall] is not None else self.next[fall]
                queue.append(after)

    def words_in(self, text: str) -> set[str]:
        found: set[str] = set()
        at = 0
        for sign in text:
            while at and sign not in self.steps[at]:
                at = self.fall[at]
            at = self.steps[at].get(sign, 0)
            hit = at if self.word[at] is not None else self.next[at]
            while hit and self.word[hit] not in found:
                found.add(self.word[hit])
                hit = self.next[hit]
        return found
