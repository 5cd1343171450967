"""Ordered pattern rules -> whom to tell about a leaked address."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import domain_of
from .values import DIRECT


@dataclass(frozen=True)
class ContactRule:
    """``pattern`` is matched from the start of the domain; ``contacts`` is a list or ``DIRECT``."""

    pattern: str
    contacts: object


# Site configuration: the patterns are the documented example rules, the desk address is the operator's own.
EXAMPLE_RULES = [
    ContactRule(r"example\.ec\.europa\.eu", ["abuse-desk@example.ec.europa.eu"]),
    ContactRule(r".*\.ec\.europa\.eu", DIRECT),
    ContactRule(r".*", DIRECT),
]


def report_to(email: Column, rules=None, full_match: bool = False) -> Column:
    """Contacts of the first rule that matches the domain; ``[""]`` where none does.

    A pattern need only match a beginning of the domain. ``full_match=True`` asks for all of it, which
    keeps ``example.ec.europa.eu.evil`` away from the first rule.
    """
    domain = domain_of(email)
    end = "$" if full_match else ""

    def arm(chain, rule):
        direct = rule.contacts == DIRECT
        value = F.array(email) if direct else F.array(*[F.lit(c) for c in rule.contacts])
        test = domain.rlike(f"^(?:{rule.pattern}){end}")
        return F.when(test, value) if chain is None else chain.when(test, value)

    rules = EXAMPLE_RULES if rules is None else rules
    chain = reduce(arm, rules, None)
    nobody = F.array(F.lit(""))
    return nobody if chain is None else chain.otherwise(nobody)
