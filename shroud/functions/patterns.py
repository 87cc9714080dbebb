"""Pattern registry (X1-X3): one entry per regex detector.

The reference's regexes are written for Python ``re``.  They run here on the
JVM, so every pattern is compiled with ``(?iU)`` (Unicode classes and
Unicode case folding, as Python does for ``str`` patterns), with two
documented departures:

* the region run of the address pattern is written without a repeated group, which
  overflows the JVM stack on long unpunctuated texts;
* a VIN must contain a digit or stand after a VIN context word, otherwise every
  17-letter word without i/o/q would be a VIN.

EMAIL_ADDRESS, PHONE_NUMBER, CREDIT_CARD and English PERSON come from a
third-party library in the reference; the regexes for them below are our own
definitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from .phones import RUN as PHONE_RUN
from .phones import plan_length

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): regexes, base scores, context words
# ---------------------------------------------------------------------------

INN_12 = r"\b\d{12}\b"
INN_10 = r"\b\d{10}\b"
OGRN_15 = r"\b\d{15}\b"
OGRN_13 = r"\b\d{13}\b"
PASSPORT_SPLIT_SERIES = r"(?:серия|серии)\s+\d{2}\s+\d{2}\s*[№#]\s*\d{6}"
PASSPORT_NOM = r"\b\d{4}\s*№\s*\d{6}\b"
PASSPORT_LABELED = r"(?:серия|серии)\s+\d{4}\s+номер[а]?\s+\d{6}"
PASSPORT_REVERSED = r"\b\d{4}\s+(?:серия|серии)\s+\d{6}\b"
PASSPORT_SPACE = r"\b\d{4}\s\d{6}\b"
PASSPORT_NOSPACE = r"\b\d{4}\d{6}\b"
SNILS = r"\b\d{3}-\d{3}-\d{3}\s\d{2}\b"
SNILS_NOSPACE = r"\b\d{11}\b"
PHONE_7PLUS = r"(?<!\d)(\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?!\d)"
PHONE_SHORT = r"\b\d{3}[\s\-]\d{2}[\s\-]\d{2}\b"
ADDR_GEO_CITY = r"(?:г\.|город|пос\.|с\.)\s+[\w\-]+,\s*"
ADDR_ST_ABBR = r"(?:ул\.|пр\.|пр-т|просп\.|пер\.|ш\.|наб\.|бул\.|пл\.|мкр\.)"
ADDR_ST_FULL = r"(?:проспект|улица|переулок|шоссе|набережная|бульвар|площадь)"
ADDR_HOUSE = r"д\.\s*\d+[\w\/\-]*"
ADDR_SUITE = r"(?:,\s*(?:кв\.|оф\.|корп\.|стр\.)\s*\d+[\w\/]*)?"
CARD_SPACED = r"\b\d{4}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{4}\b"
CARD_AMEX = r"\b\d{4}[\s\-]\d{6}[\s\-]\d{5}\b"
CARD_PLAIN = r"\b\d{13,19}\b"
ACCOUNT_20 = r"\b\d{20}\b"
BIK_9 = r"\b\d{9}\b"
KPP_9 = r"\b\d{9}\b"
VIN_17 = r"\b[A-HJ-NPR-Z0-9]{17}\b"

CONTEXT_INN = ["инн", "инн:", "inn", "налогоплательщик"]
CONTEXT_OGRN = ["огрн", "огрнип", "ogrn"]
CONTEXT_PASSPORT = ["паспорт", "серия", "серии", "номер паспорта", "passport"]
CONTEXT_SNILS = ["снилс", "страховой", "snils"]
CONTEXT_ADDRESS = ["адрес", "адресу", "прописан", "зарегистрирован", "проживает",
                   "место жительства", "регистрация", "прописка"]
CONTEXT_CARD = ["карта", "карточка", "номер карты", "card", "visa",
                "mastercard", "мир", "maestro", "оплата", "платёж"]
CONTEXT_ACCOUNT = ["счёт", "счет", "р/с", "к/с", "расчёт", "расчет", "корреспондент"]
CONTEXT_BIK = ["бик", "bik"]
CONTEXT_KPP = ["кпп", "kpp"]
CONTEXT_VIN = ["vin", "вин", "кузов", "птс", "стс", "свидетельство",
               "транспортное средство", "идентификационный номер"]

# ---------------------------------------------------------------------------
# Our own definitions for the library detectors (choices, not reference data)
# ---------------------------------------------------------------------------

EMAIL_RE = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}\b"
PHONE_INTL_RE = r"(?<![\w+])(?:\+\d{1,3}[\s\-]?)?(?:\(\d{3}\)|\d{3})[\s\-]?\d{3}[\s\-]?\d{4}(?!\w)"
CREDIT_CARD_RE = r"\b\d{4}[\s\-]?\d{3,4}[\s\-]?\d{3,4}[\s\-]?\d{3,5}\b"
# English person: a title or a capitalised given name followed by a
# capitalised surname.  Case-sensitive on purpose.
PERSON_EN_RE = (
    r"\b(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+)?"
    r"|(?:John|Jane|James|Mary|Robert|Patricia|Michael|Jennifer|William|Linda|"
    r"David|Elizabeth|Richard|Barbara|Joseph|Susan|Thomas|Jessica|Charles|Sarah|"
    r"Daniel|Karen|Peter|Anna|Paul|Laura|Mark|Emma|George|Alice)\s+\p{Lu}\p{Ll}+)\b"
)

SCORE_EMAIL = 0.5
SCORE_PHONE_INTL = 0.4
SCORE_PHONE_PLAN = 0.75     # a calling code and an allowed length
SCORE_CREDIT_CARD = 0.3
SCORE_PERSON_EN = 0.85


def _address_full() -> str:
    # The region: a run of words, written without a repeated group (which overflows the
    # JVM stack); the look-behinds let it start only where a run of words starts.
    region = r"(?:(?<![\w\-])(?<![\w\-]\s)[\w\-][\w\-\s]*\s(?:обл\.|кр\.|р-на?),\s*)?"
    geo = region + ADDR_GEO_CITY
    return (geo + "(?:" + ADDR_ST_ABBR + "|" + ADDR_ST_FULL + r")\s+[\w\s\-\.\"«»]{2,40},\s*"
            + ADDR_HOUSE + ADDR_SUITE)


def _address_street_only() -> str:
    return ADDR_ST_ABBR + r"\s+[\w\s\-\.\"«»]{2,40},\s*" + ADDR_HOUSE + ADDR_SUITE


def _address_no_abbr() -> str:
    return ADDR_ST_FULL + r"\s+[\w\s\-]{2,40},\s*\d+[а-яёА-ЯЁ]?(?:\/\d+)?"


# Row gates: a pattern only runs on rows whose gate column is true.
GATE_DIGIT9 = "digit9"     # needs a run of 9+ digits
GATE_DIGIT = "digit"       # needs a digit
GATE_AT = "at"             # needs '@'
GATE_NONE = "none"

GATE_REGEX = {
    GATE_DIGIT9: r"(?U)\d{9}",
    GATE_DIGIT: r"(?U)\d",
    GATE_AT: r"@",
}


@dataclass(frozen=True)
class PatternDef:
    entity_type: str
    name: str
    regex: str            # JVM regex, flags included
    score: float
    context: tuple[str, ...] = ()
    validator: object = None           # 'card' -> digits 13..19 + Luhn; or a function of the hit column (X2)
    context_required: bool = False     # F1 (BIK/KPP)
    gate: str = GATE_DIGIT
    refine: object = None              # a function of the hit column: how many of its characters count (null: no hit)

    @property
    def custom(self) -> bool:
        from ..config import CUSTOM_ENTITY_TYPES
        return self.entity_type in CUSTOM_ENTITY_TYPES


def _iu(r: str) -> str:
    return "(?iU)" + r


# In any case, so that no VIN stays in clear; a digit tells it from a word, or a VIN context word on its left.
VIN_JVM = r"(?iU)\b(?=[A-HJ-NPR-Z0-9]{0,16}[0-9])[A-HJ-NPR-Z0-9]{17}\b"
VIN_LETTERS_JVM = r"(?iU)\b[A-HJ-NPR-Z]{17}\b"

# Registration order of recognizers (used as the last tie-break).
REGISTRY: tuple[PatternDef, ...] = (
    PatternDef("INN_RU", "INN_12", _iu(INN_12), 0.85, tuple(CONTEXT_INN), gate=GATE_DIGIT9),
    PatternDef("INN_RU", "INN_10", _iu(INN_10), 0.75, tuple(CONTEXT_INN), gate=GATE_DIGIT9),
    PatternDef("OGRN_RU", "OGRN_15", _iu(OGRN_15), 0.85, tuple(CONTEXT_OGRN), gate=GATE_DIGIT9),
    PatternDef("OGRN_RU", "OGRN_13", _iu(OGRN_13), 0.80, tuple(CONTEXT_OGRN), gate=GATE_DIGIT9),
    PatternDef("PASSPORT_RU", "PASSPORT_SPLIT_SERIES", _iu(PASSPORT_SPLIT_SERIES), 0.97, tuple(CONTEXT_PASSPORT)),
    PatternDef("PASSPORT_RU", "PASSPORT_NOM", _iu(PASSPORT_NOM), 0.90, tuple(CONTEXT_PASSPORT)),
    PatternDef("PASSPORT_RU", "PASSPORT_LABELED", _iu(PASSPORT_LABELED), 0.95, tuple(CONTEXT_PASSPORT)),
    PatternDef("PASSPORT_RU", "PASSPORT_REVERSED", _iu(PASSPORT_REVERSED), 0.85, tuple(CONTEXT_PASSPORT)),
    PatternDef("PASSPORT_RU", "PASSPORT_SPACE", _iu(PASSPORT_SPACE), 0.85, tuple(CONTEXT_PASSPORT)),
    PatternDef("PASSPORT_RU", "PASSPORT_NOSPACE", _iu(PASSPORT_NOSPACE), 0.70, tuple(CONTEXT_PASSPORT), gate=GATE_DIGIT9),
    PatternDef("SNILS_RU", "SNILS", _iu(SNILS), 0.90, tuple(CONTEXT_SNILS)),
    PatternDef("SNILS_RU", "SNILS_NOSPACE", _iu(SNILS_NOSPACE), 0.65, tuple(CONTEXT_SNILS), gate=GATE_DIGIT9),
    PatternDef("PHONE_RU", "PHONE_7PLUS", _iu(PHONE_7PLUS), 0.90),
    PatternDef("PHONE_RU", "PHONE_SHORT", _iu(PHONE_SHORT), 0.60),
    PatternDef("ADDRESS_RU", "ADDRESS_FULL", _iu(_address_full()), 0.85, tuple(CONTEXT_ADDRESS)),
    PatternDef("ADDRESS_RU", "ADDRESS_STREET_ONLY", _iu(_address_street_only()), 0.75, tuple(CONTEXT_ADDRESS)),
    PatternDef("ADDRESS_RU", "ADDRESS_NO_ABBR", _iu(_address_no_abbr()), 0.70, tuple(CONTEXT_ADDRESS)),
    PatternDef("CARD", "CARD_SPACED", _iu(CARD_SPACED), 0.85, tuple(CONTEXT_CARD), validator="card"),
    PatternDef("CARD", "CARD_AMEX", _iu(CARD_AMEX), 0.85, tuple(CONTEXT_CARD), validator="card"),
    PatternDef("CARD", "CARD_PLAIN", _iu(CARD_PLAIN), 0.50, tuple(CONTEXT_CARD), validator="card", gate=GATE_DIGIT9),
    PatternDef("VIN", "VIN", VIN_JVM, 0.70, tuple(CONTEXT_VIN)),
    PatternDef("VIN", "VIN_LETTERS", VIN_LETTERS_JVM, 0.70, tuple(CONTEXT_VIN), context_required=True, gate=GATE_NONE),
    PatternDef("ACCOUNT_RU", "ACCOUNT_20", _iu(ACCOUNT_20), 0.85, tuple(CONTEXT_ACCOUNT), gate=GATE_DIGIT9),
    PatternDef("BIK_RU", "BIK_9", _iu(BIK_9), 0.85, tuple(CONTEXT_BIK), context_required=True, gate=GATE_DIGIT9),
    PatternDef("KPP_RU", "KPP_9", _iu(KPP_9), 0.85, tuple(CONTEXT_KPP), context_required=True, gate=GATE_DIGIT9),
    # Library detectors (our regexes).
    PatternDef("EMAIL_ADDRESS", "EMAIL", _iu(EMAIL_RE), SCORE_EMAIL, gate=GATE_AT),
    PatternDef("CREDIT_CARD", "CREDIT_CARD", _iu(CREDIT_CARD_RE), SCORE_CREDIT_CARD, validator="card"),
    PatternDef("PHONE_NUMBER", "PHONE_NUMBER", _iu(PHONE_INTL_RE), SCORE_PHONE_INTL),
    PatternDef("PHONE_NUMBER", "PHONE_PLAN", PHONE_RUN, SCORE_PHONE_PLAN, refine=plan_length),
    PatternDef("PERSON", "PERSON_EN", "(?U)" + PERSON_EN_RE, SCORE_PERSON_EN, gate=GATE_NONE),
)

PRIORITY_RANK = {p.name: i for i, p in enumerate(REGISTRY)}


def patterns_for(language: str, entity_types=None) -> list[PatternDef]:
    """Patterns that run for ``language`` (F5), optionally restricted."""
    from ..config import detector_runs_for
    out = []
    for p in REGISTRY:
        if not detector_runs_for(p.entity_type, language):
            continue
        if entity_types is not None and p.entity_type not in entity_types:
            continue
        out.append(p)
    return out


def add_recognizer(entity_type: str, name: str, regex: str, score: float,
                   context=(), validator=None, context_required=False,
                   gate=GATE_NONE, flags="(?iU)") -> PatternDef:
    """Build a registry entry for a user recognizer (append it to a copy
    of REGISTRY and pass that list to ``detect``)."""
    return PatternDef(entity_type, name, flags + regex, score, tuple(context),
                      validator, context_required, gate)
