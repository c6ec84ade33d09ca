"""First-match rules over messages, written as data and run as one CASE expression."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.terms import finder
from tidemill.functions.text import blank_if_null, clip, clip_tail

IMPORTANT, NORMAL, ADVERTISEMENT, UNCERTAIN = "IMPORTANT", "NORMAL", "ADVERTISEMENT", "UNCERTAIN"
CATEGORIES = (IMPORTANT, NORMAL, ADVERTISEMENT, UNCERTAIN)
CONTENT = ("subject", "body")

# How much of a message goes to an outside judge.
DEFERRED_BODY_CHARS = 8_000
DEFERRED_CONTEXT_CHARS = 6_000


@dataclass(frozen=True)
class Terms:
    """At least ``at_least`` different terms occur in one of the fields."""

    fields: tuple[str, ...]
    terms: tuple[str, ...]
    at_least: int = 1


@dataclass(frozen=True)
class Rule:
    """``require`` all hold, ``exclude`` none; ``list_header`` asks for a mailing-list header."""

    id: int
    category: str
    reason: str
    require: tuple[Terms, ...]
    exclude: tuple[Terms, ...] = ()
    list_header: bool = False


# The terms, order, categories and reasons of the mail rules.
SMART_HOME_SENDERS = ("coolkit.cc", "coolkit.cn", "ewelink.cc")
SMART_HOME_SUBJECTS = ("scene", "radiatory", "radiator", "is trigged", "is triggered")
DATA_BOX_SENDERS = ("mojedatovaschranka.cz",)
DATA_BOX_SUBJECTS = ("nová zpráva", "nova zprava")
DELIVERY_FAILURE_TERMS = (
    "nedoručiteln", "delivery status notification", "delivery failed", "undelivered mail",
    "mail delivery failed", "failure notice", "returned mail", "could not be delivered",
    "message not delivered",
)
SECURITY_TERMS = (
    "verification code", "ověřovací kód", "security alert", "bezpečnostní upozornění", "new sign-in",
    "nové přihlášení", "new login", "suspicious activity", "podezřelá aktivita",
)
RECEIPT_TERMS = (
    "faktura", "invoice", "stvrzenka", "receipt", "potvrzení platby", "potvrzeni platby", "payment receipt",
)
PROBLEM_TERMS = (
    "nezaplac", "po splatnosti", "overdue", "failed", "zamítnut", "declined", "problém", "problem",
    "nutná akce", "action required",
)
SOCIAL_SENDERS = (
    "messages-noreply@linkedin.com", "notifications-noreply@linkedin.com",
    "updates-noreply@linkedin.com", "newsletters-noreply@linkedin.com",
)
MARKETING_TERMS = (
    "unsubscribe", "odhlásit odběr", "odhlásit se", "newsletter", "sleva", "slevový kód", "promo",
    "special offer", "akční nabídka", "výprodej", "nabídka služeb", "nabídka produktů", "cashback",
    "bonus", "výhodná nabídka", "produktová nabídka",
)
MAIL_RULES = (
    Rule(1, NORMAL, "Automatická provozní notifikace chytré domácnosti bez požadavku na akci.",
         (Terms(("sender",), SMART_HOME_SENDERS), Terms(("subject",), SMART_HOME_SUBJECTS))),
    Rule(2, IMPORTANT, "Oznámení o nové zprávě v datové schránce vyžaduje pozornost.",
         (Terms(("sender",), DATA_BOX_SENDERS), Terms(("subject",), DATA_BOX_SUBJECTS))),
    Rule(3, IMPORTANT, "Systémová zpráva o nedoručení nebo problému s doručením.",
         (Terms(CONTENT, DELIVERY_FAILURE_TERMS),)),
    Rule(4, IMPORTANT, "Bezpečnostní nebo přihlašovací upozornění účtu.",
         (Terms(CONTENT, SECURITY_TERMS),)),
    Rule(5, NORMAL, "Běžná faktura nebo potvrzení platby bez požadavku na další akci.",
         (Terms(("subject",), RECEIPT_TERMS),), exclude=(Terms(CONTENT, PROBLEM_TERMS),)),
    Rule(6, ADVERTISEMENT, "Automatická LinkedIn notifikace nebo obsahová propagace.",
         (Terms(("sender",), SOCIAL_SENDERS),)),
    Rule(7, ADVERTISEMENT, "Hromadná obchodní komunikace s marketingovým obsahem.",
         (Terms(CONTENT, MARKETING_TERMS),), list_header=True),
    Rule(8, ADVERTISEMENT, "Zpráva obsahuje více typických znaků marketingové komunikace.",
         (Terms(CONTENT, MARKETING_TERMS, at_least=2),)),
)


def signal_count(fields: Sequence[Column], terms: Sequence[str]) -> Column:
    """How many different terms occur in any of the lower-cased fields."""
    return reduce(
        lambda total, term: total + _occurs(fields, term).cast("int"), terms, F.lit(0)
    )


def _occurs(fields: Sequence[Column], term: str) -> Column:
    return reduce(Column.__or__, (F.contains(field, F.lit(term)) for field in fields))


def _holds(condition: Terms, lowered: dict[str, Column]) -> Column:
    fields = [lowered[field] for field in condition.fields]
    if condition.at_least == 1:
        return reduce(Column.__or__, (_occurs(fields, term) for term in condition.terms))
    return signal_count(fields, condition.terms) >= condition.at_least


def count_signals(
    df: DataFrame, terms: Sequence[str], columns: Sequence[str] = CONTENT, out_col: str = "signal_count"
) -> DataFrame:
    """Add the number of different terms found, case-insensitively, in the columns."""
    lowered = {f"_lower_{column}": F.lower(blank_if_null(F.col(column))) for column in columns}
    fields = [F.col(name) for name in lowered]
    return df.withColumns(lowered).withColumn(out_col, signal_count(fields, terms)).drop(*lowered)


def _fields(rules: Sequence[Rule]) -> list[str]:
    return sorted({field for rule in rules for terms in (*rule.require, *rule.exclude) for field in terms.fields})


def _with_first_rule(prepared: DataFrame, rules: Sequence[Rule], holds: Callable[[Terms], Column]) -> DataFrame:
    """Category, reason and number of the first rule whose terms ``holds`` says to be there.

    The number comes out of a one-element inline, so that a later filter on the outcome does not make Catalyst
    repeat the whole CASE, and the lower-casing of every term's text, below it.
    """
    chain = None
    for rule in rules:
        tests = [holds(terms) for terms in rule.require]
        tests += [~holds(terms) for terms in rule.exclude]
        if rule.list_header:
            headers = (blank_if_null(F.col(name)) != "" for name in ("list_unsubscribe", "list_id"))
            tests.insert(0, reduce(Column.__or__, headers))
        all_hold = reduce(Column.__and__, tests)
        chain = F.when(all_hold, rule.id) if chain is None else chain.when(all_hold, rule.id)

    def looked_up(attribute: str) -> Column:
        pairs = [F.lit(item) for rule in rules for item in (rule.id, getattr(rule, attribute))]
        return F.try_element_at(F.create_map(*pairs), F.col("rule_id"))

    found = prepared.select("*", F.inline(F.array(F.struct(chain.alias("rule_id")))))
    return found.withColumns({"category": looked_up("category"), "reason": looked_up("reason")})


def classify(df: DataFrame, rules: Sequence[Rule] = MAIL_RULES) -> DataFrame:
    """Add category, reason and rule_id of the first rule that holds; NULL when none does.

    Each text is lower-cased once; a CASE stops at the first match, and the rule number
    then looks up category and reason.
    """
    texts = _fields(rules)
    prepared = df.withColumns({f"_lower_{field}": F.lower(blank_if_null(F.col(field))) for field in texts})
    lowered = {field: F.col(f"_lower_{field}") for field in texts}
    return _with_first_rule(prepared, rules, lambda terms: _holds(terms, lowered)).drop(*(f"_lower_{field}" for field in texts))


def find_terms(df: DataFrame, terms: Sequence[str], columns: Sequence[str], prefix: str = "found_") -> DataFrame:
    """Add ``found_<column>``: the sorted numbers of the different terms, places in ``terms``, that occur in a text.

    Case is folded as in ``classify``. The work does not grow with the number of terms, unlike a test a term; of
    terms given twice the first counts.
    """
    find = finder(df.sparkSession, [term.lower() for term in terms])
    return df.withColumns({f"{prefix}{column}": find(F.lower(blank_if_null(F.col(column)))) for column in columns})


def classify_by_vocabulary(df: DataFrame, rules: Sequence[Rule] = MAIL_RULES) -> DataFrame:
    """``classify`` for rules with very many terms: each text is read once for all terms of all rules.

    For the few dozen terms of the mail rules the CASE of ``classify`` is as good and needs no Python.
    """
    texts = _fields(rules)
    terms = list(dict.fromkeys(term for rule in rules for part in (*rule.require, *rule.exclude) for term in part.terms))
    number = {term: at for at, term in enumerate(terms)}
    prepared = find_terms(df, terms, texts, "_found_")

    def holds(part: Terms) -> Column:
        anywhere = reduce(F.array_union, (F.col(f"_found_{field}") for field in part.fields))
        asked = F.array(*(F.lit(number[term]) for term in part.terms))
        if part.at_least == 1:
            return F.arrays_overlap(anywhere, asked)
        return F.size(F.array_intersect(anywhere, asked)) >= part.at_least

    return _with_first_rule(prepared, rules, holds).drop(*(f"_found_{field}" for field in texts))


def deferred(df: DataFrame) -> DataFrame:
    """Messages no rule decided, with what an outside judge gets to see of them."""
    return df.filter(F.col("category").isNull()).select(
        "id", "sender", "subject", "date",
        clip(F.col("body"), DEFERRED_BODY_CHARS).alias("body"),
        clip_tail(F.col("thread_context"), DEFERRED_CONTEXT_CHARS).alias("thread_context"),
    )


def merge_labels(classified: DataFrame, external: DataFrame) -> DataFrame:
    """The rule's decision, else the external one (id, category, reason).

    External rows of an unknown category are ignored and of several rows for one id one
    is taken, so the result has one row per message. ``source`` is rule, external or
    NULL for a message that stays unprocessed.
    """
    one_each = (
        external.filter(F.col("category").isin(*CATEGORIES))
        .groupBy("id")
        .agg(F.min(F.struct("category", "reason")).alias("_external"))
    )
    joined = classified.join(one_each, "id", "left")
    by_rule = F.col("category").isNotNull()
    return joined.withColumns(
        {
            "source": F.when(by_rule, "rule").when(F.col("_external").isNotNull(), "external"),
            "reason": F.when(by_rule, F.col("reason")).otherwise(F.col("_external.reason")),
            "category": F.coalesce("category", "_external.category"),
        }
    ).drop("_external")
