"""Personal information in free text: detection, and keyed surrogates in its place (problem 2).

Mentions are found by patterns for addresses of mail, numbers and places. Persons are found by given names (also in
inflected Cyrillic forms), initials and family names in sequence, and by titles and phrases that announce a name. What
the corpus itself tells is learned by aggregates: a capitalised word that stands before several family names known from
such mentions, and seldom before other words, is a given name too, and a lower-case word after a given name is a family
name if it is one elsewhere.

Each distinct entity then gets one replacement of its kind: a name of the same gender and script, a number of the same
format, a mail address, a street. Replacements come from a keyed hash of the entity's normal form, so one entity has one
replacement in every row (coreference); a check over all entities of the run moves a second bearer of a replacement to
another one, and any replacement that is an entity of the run itself (distinctness). Entities are joined by value, never
gathered.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import checkpointed, read_table

# Given names by script and gender; words that are common nouns or verbs in their language are left out.
LATIN_F = (
    "anna maria emma sophie julia laura marta elena olga irina natalia katarzyna agnieszka carmen lucia claire chloe hannah alice sarah emily clara maren leonie ingrid wanda selma "
    "priya orla nadia mina ilka petra sabine ursula monika helga ines pilar teresa isabel camille juliette margot zofia ewa magdalena barbara karolina fatima aisha mei yuki lena nina"
).split()
LATIN_M = (
    "hugo kofi yusuf tomas rafael joss dario benedek anselm peter paul james john thomas michael david daniel robert andrew stefan hans klaus jürgen wolfgang dieter lukas jonas felix "
    "pierre jacques michel antoine luc mathieu carlos miguel javier diego pablo andrés jan piotr marek tomasz krzysztof andrzej paweł ahmed omar ali ravi hiroshi kenji ivan oleg igor sergei dmitri"
).split()
CYRILLIC_F = "вера ксения ксенія лидия лідія олена дарина злата анна мария марія ольга ирина ірина наталья наталія светлана світлана екатерина катерина елена оксана татьяна тетяна юлия юлія галина валентина людмила марина алина аліна софия софія".split()
CYRILLIC_M = "роман мирон игорь ігор назар тарас богдан иван іван петр пётр петро александр олександр сергей сергій дмитрий дмитро андрей андрій владимир володимир михаил михайло николай микола павел павло алексей олексій артем артём виктор віктор максим олег юрий юрій остап".split()
# Further given names; surrogates are drawn from the lists above only.
MORE_F = (
    "mary patricia jennifer linda elizabeth susan jessica karen lisa nancy betty margaret sandra ashley kimberly donna michelle carol amanda melissa deborah stephanie rebecca sharon cynthia kathleen amy angela shirley "
    "brenda pamela nicole samantha catherine christine rachel carolyn janet heather diane julie joyce victoria kelly christina joan evelyn judith megan andrea cheryl jacqueline martha gloria teresa ann sara madison "
    "frances kathryn janice jean abigail alexandra judy sofia denise marilyn amber danielle beverly charlotte natalie theresa diana brittany doris kayla alexis lori jane eleanor helen ruth dorothy olivia ella mia isla lucy "
    "renate brigitte gisela karin birgit heike sabrina anja silke katrin martina claudia nicole susanne angelika gabriele johanna lieselotte greta frieda annika svenja "
    "josefa dolores rosario mercedes concepción antonia manuela francisca beatriz rocío silvia paula raquel lorena nuria inés sofía valentina ximena guadalupe "
    "nathalie valérie sylvie céline aurélie élodie amélie émilie hélène françoise brigitte martine véronique manon léa chantal monique "
    "małgorzata krystyna joanna elżbieta halina grażyna bożena agata karolina beata dorota justyna aleksandra zuzanna hanna alicja kinga "
    "giulia francesca chiara federica paola fatma zeynep ayşe leila layla maryam zainab khadija amina noor priyanka anjali deepa lakshmi sunita kavita ananya mei-ling xiaoli yan sakura yumi keiko haruka "
    "gertrude bernadette henrietta josephine constance harriet philippa imogen beatrice agatha edith mildred ethel winifred rosemary genevieve marguerite bernadeta jadwiga stanisława wiesława bogumiła leokadia gisele odette simone ilse waltraud liesel roswitha consuelo graciela marisol esperanza ngozi amara adaeze chioma folake wanjiru astrid freja sigrid solveig kirsten anneke marieke femke oksana svitlana tetiana yulia ekaterina tatiana svetlana ludmila galina anastasia daria"
).split()
MORE_M = (
    "william richard joseph charles christopher matthew anthony donald steven kenneth joshua kevin brian george timothy ronald edward jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon "
    "benjamin samuel gregory alexander patrick raymond dennis jerry tyler aaron jose adam nathan henry douglas zachary kyle walter ethan jeremy harold keith christian roger noah gerald terry sean austin arthur lawrence jesse "
    "dylan bryan joe jordan billy bruce albert willie gabriel logan alan juan wayne roy ralph randy eugene vincent russell elijah louis bobby philip johnny oliver leo theodore edgar simon martin tim tom mike steve fred harry jim "
    "günter helmut gerhard manfred heinz horst werner uwe rainer matthias andreas thorsten torsten sebastian florian tobias markus lars sven jens holger friedrich heinrich "
    "josé antonio manuel francisco luis fernando rafael ángel alejandro sergio alberto álvaro joaquín ramón enrique raúl rubén ignacio jesús eduardo ricardo roberto "
    "jean philippe françois nicolas laurent olivier julien sébastien guillaume thierry pascal frédéric christophe étienne rené gérard yves "
    "stanisław zbigniew jerzy tadeusz ryszard henryk mateusz jakub kacper bartosz wojciech grzegorz łukasz maciej kamil szymon "
    "marco luca matteo giovanni giuseppe alessandro mohammed mohamed muhammad mustafa hassan hussein ibrahim khalid mehmet emre murat arjun rahul rajesh sanjay suresh vikram amit anil wei jun hao takashi kenta satoshi minh tuan "
    "reginald cuthbert percival ambrose bartholomew montgomery leopold ferdinand siegfried gottfried eberhard ignatius bolesław kazimierz zygmunt leszek gustavo hernando octavio anatole gaston marcel chinedu emeka kwame kwesi oluwaseun sipho thabo björn magnus erik nils anders jeroen pieter willem sergey dmytro dmitry alexei aleksei mikhail nikolai vladimir viktor andriy serhiy mykola oleksandr pavel yuri artem bohdan taras"
).split()
MORE_CYRILLIC_F = "александра алла анастасия анастасія антонина валерия валерія варвара василиса вероника віра надежда надія евгения євгенія евдокия елизавета єлизавета жанна зинаида зоя инна інна карина кира лариса любов маргарита марта нина ніна полина поліна раиса регина римма тамара ульяна эльвира яна соломія уляна христина богдана ганна катерина ярослава".split()
MORE_CYRILLIC_M = "анатолий анатолій антон аркадий борис валентин валерий валерій вадим василий василь виталий віталій владислав всеволод вячеслав геннадий георгий глеб григорий григорій даниил данило денис евгений євген егор захар иннокентий илья ілля кирилл кирило константин костянтин лев леонид леонід матвей никита микита петр руслан савва семен семён станислав степан тимофей тимур федор фёдор филипп юхим ярослав яков".split()
# Given names that are words too and count only with a capital letter.
CASED = set("mark will grace rose bill frank jack hope faith joy art dean dale ruby ivy daisy lily pearl max drew chase grant miles ray april june may summer sky jean christian jordan austin logan terry scott tyler angela sara ella mia leo simon martin joe jim lars wei jun hao yan noor лев вера роман надежда любов надія віра".split())
# Those of them that open English sentences; there they count only before the ending of a family name.
OPENERS = set("mark will grace rose bill frank hope faith joy dean dale pearl max drew chase grant miles ray".split())
# Family names of two and three letters, which are accepted after an initial.
SHORT_FAMILY = set("li lee wu xu yu ma ho hu lu su ng le vu bui kim han oh cho roy fox cox ray orr ali ito ono ota abe rao das sen dey kaur gil paz rey rio rou roux lai lam lau lim lin liu mai tan tam tao teo tse wei yan yip yee fan fu gao guo hsu kay kok koh kwa pao poe pym rae uhl ott orth koc łoś цой ким пак кац хан лі лю чан югай".split())
# Titles and phrases that announce a person, so that the given name need not be on a list.
CUE_TITLES = "mr mrs ms dr herr frau prof sr sra mme mlle señor señora monsieur madame pan pani г-н г-жа господин госпожа пан пані".split()
CUE_PHRASES = ["name is", "i am called", "ich heiße", "mein name ist", "me llamo", "nombre es", "je m'appelle", "mon nom est", "nazywam się", "меня зовут", "мене звати", "моє ім'я", "моё имя"]
CUE = re.compile(rf"(?i:(?<!\w)(?:(?:{'|'.join(CUE_TITLES)})\.?|{'|'.join(CUE_PHRASES)}))[ \u00a0](?=[^\W\d_])")
# Words that open sentences or stand beside a letter with a dot, and so are no family names.
NOT_FAMILY = set(
    (
        "the this that these those when then there what where which who why how for from with without and but because once since during before after under outside inside as at in on of to by is was are "
        "please remember forward ask call can could we you they she he it its our your his her not yes no ok done good here hello hi hey dear hallo hola bonjour cześć привет привіт thanks regards contact send ship write build host ticket order street reviewed kind "
        "если когда почему после перед для под при это этот эта что как где кто мой моя мне меня вот готово запомни запиши проверь объясни нужна пишите перезвоните копию клиент живу отправьте спасибо "
        "якщо коли чому після перед для під при це цей ця що як де хто мій моя мене ось готово запам запиши перевір поясни потрібна пишіть зателефонуйте копію клієнт тепер надішліть дякую "
        "der die das den dem ein eine und aber wenn wann warum nach vor für mit bei wir sie was ist el la los las un una y pero cuando por para con le les des une et mais quand pour avec au à se przed po pod dla kiedy co czy"
    ).split()
)
# Endings that mark a lower-case word after a given name as a family name.
FAMILY_END = re.compile(
    r"(?:son|sen|man|mann|er|ling|inger|ski|sky|ska|ov|ova|ev|eva|ko|ez|etto|ini|elli|adze|hurst|wick|way|ley|ton|ford|berg|stein|ander|ivka|elmi|var|dt|czyk|wicz|vić|escu|ński|ńska|ский|ская|цкий|ин|ина|ук|юк|ко|ич|ов|ова|ев|ева|дзе|мар|ян)(?:$|-)"
)

FIRST = {**dict.fromkeys(LATIN_F, "f"), **dict.fromkeys(LATIN_M, "m"), **dict.fromkeys(CYRILLIC_F, "f"), **dict.fromkeys(CYRILLIC_M, "m")}
GENDER = {**{w: g for ws, g in ((MORE_F, "f"), (MORE_M, "m"), (MORE_CYRILLIC_F, "f"), (MORE_CYRILLIC_M, "m")) for w in ws}, **dict.fromkeys("grace rose hope faith joy ruby ivy daisy lily pearl".split(), "f"), **dict.fromkeys("mark bill frank jack dean dale max grant miles ray".split(), "m"), **FIRST}
CASED -= {*FIRST}  # those keep counting in lower case
# Endings of Cyrillic given names in their cases.
CASES = ("ові", "еві", "єві", "ою", "ею", "єю", "ём", "ом", "ем", "єм", "им", "ым", "ию", "ии", "у", "ю", "а", "я", "е", "є", "і", "ї", "и", "ы", "й", "ь", "")
STEMS = {re.sub(r"[аяйь]$", "", w): w for w in (*CYRILLIC_F, *CYRILLIC_M, *MORE_CYRILLIC_F, *MORE_CYRILLIC_M) if len(w) > 3}


def base_given(word: str) -> str | None:
    """The listed given name that a lower-case word is, or a form of; None for other words."""
    if word in GENDER:
        return word
    if "а" <= word[:1] <= "ґ":
        for end in CASES:
            if end and word.endswith(end) and word[: -len(end)] in STEMS:
                return STEMS[word[: -len(end)]]
    return None


def base_family(word: str, gender: str | None) -> str:
    """A lower-case Cyrillic family name in -ов, -ев, -ин without its case; a woman's keeps its -а."""
    m = re.fullmatch(r"(.{2,}(?:ов|ев|ёв|ин))(?:а|у|ым|ом|е|ой|ою)?", word)
    return word if not m else m[1] + "а" * (gender == "f")

WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
GAP = re.compile(r"[  \t]{1,2}|\n")

# --- fixed values: formats ------------------------------------------------------------------------------------------
AT = r"(?: ?@ ?| ?[\[(] ?at ?[\])] ?)"
DOT = r"(?:\.| ?[\[(] ?dot ?[\])] ?)"
EMAIL = re.compile(rf"[A-Z0-9](?:[A-Z0-9._%+\-]*[A-Z0-9])?{AT}[A-Z0-9][A-Z0-9\-]*(?:{DOT}[A-Z0-9\-]+)*{DOT}[A-Z]{{2,12}}(?![A-Z0-9])(?!:[\w~]+/)", re.I)
SEP = "[  .\\-‐‑]"
EXT = r"(?: ?(?:ext\.?|x|доб\.?) ?\d{1,5})?"
PHONE = re.compile(
    rf"(?<![\w+])(?:\+\d{{1,3}}{SEP}?\(?\d{{1,4}}\)?(?:{SEP}?\d{{2,5}}){{1,4}}"
    rf"|00 \d{{2,3}}(?: \d{{2,5}}){{2,4}}|00[1-9](?=(?:[^\w]{{0,2}}\d){{8}})\d{{0,2}}(?:{SEP}?\(?\d{{1,5}}\)?){{2,5}}(?<=\d{{2}})"
    rf"|0\d{{1,4}}[ \u00a0/]\d{{5,8}}|0\d{{2}}{SEP}\d{{3}}(?:{SEP}\d{{2}}){{2}}|0\d(?:{SEP}\d{{2}}){{4}}|0\d{{2,4}}{SEP}\d{{3,4}}{SEP}\d{{3,4}}"
    rf"|8{SEP}?\(\d{{3}}\){SEP}?\d{{3}}{SEP}?\d{{2}}{SEP}?\d{{2}}"
    rf"|\(\d{{3}}\){SEP}?\d{{3}}{SEP}?\d{{2}}{SEP}?\d{{2}}"
    rf"|\d{{3}}[.\-‐‑]\d{{3}}[.\-‐‑]\d{{4}}){EXT}(?![\w\-])"
)
ID = re.compile(
    r"(?:\bssn\b|social security(?: (?:number|no\.?))?|\bpassport\b|национальн\w+ паспорт\w*|паспорт\w*|national insurance(?: (?:number|no\.?))?|\bNI (?:number|no\.?)|driv(?:ing|er'?s?) licen[cs]e|tax id|\bИНН\b|\bІПН\b|РНОКПП|СНИЛС"
    r"|сери[яи] и номер|серія (?:та|і) номер|\bid card\b|identity (?:card|number)|personal id|Personalausweis\w*|Steuer-?ID|\bPESEL\b|\bDNI\b|водительск\w+ \w+)"
    r"(?: (?:number|no\.?|номер|is|№))*\s*(?:[:=#№]|is)?\s*"
    r"((?:[A-ZА-ЯІЇЄҐ]{1,3}[ \-]?)?\d(?:[ \-]?\d){4,13}(?: ?[A-Z](?![\w]))?)",
    re.I,
)
EN_KIND = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Close|Drive|Dr|Court|Ct|Way|Place|Square|Terrace|Crescent)\b\.?"
TOWN = r"[A-ZА-ЯІЇЄҐ][^\W\d_]+(?:[ \-][A-ZА-ЯІЇЄҐ][^\W\d_]+)?"
ADDRESS = re.compile(
    rf"(?<![\w.])(?:(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) \d+[A-Z]?, ?)?\d{{1,5}}[A-Z]? (?:[A-Z][^\W\d_]+ ){{1,3}}{EN_KIND}(?:,? (?:Flat|Apt\.?|Unit|Suite) \d+)?(?:,?[ \n]{TOWN}(?= \d{{5}}\b|,|\.|\n|$| [A-Z]{{2}} \d))?(?:,? (?:[A-Z]{{2}} )?\d{{5}}\b)?"
    rf"|[A-ZÄÖÜ][^\W\d_]*(?:gasse|straße|strasse|str\.|weg|platz|allee|ring|damm|ufer) \d+[a-z]?(?:, ?\d{{5}} {TOWN})?"
    rf"|(?:(?:г|м|гор|с|пгт|смт)\. ?{TOWN}, ?)?(?:(?:ул|вул|пер|пров|просп|пр|пл|наб)\. ?|(?:улица|вулиця|переулок|провулок|проспект|площадь|площа|бульвар|набережная|набережна) )[А-ЯІЇЄҐ][^\W\d_]+(?: [А-ЯІЇЄҐ][^\W\d_]+)?,? (?:(?:д|буд|дом|будинок)\.? ?)?\d+[а-яA-Z]?(?:/\d+)?(?:, ?(?:кв|оф)\.? ?\d+)?(?:, ?{TOWN}(?=[,.\n]|$))?"
    rf"|\d{{1,4}},? (?:rue|avenue|boulevard|place|quai) (?:de la |du |des |de |d')?[A-Z][^\W\d_]+(?:[ \-][A-Z][^\W\d_]+)*(?:, (?:\d{{5}} )?{TOWN}(?=[,.\n]|$))?|(?:Calle|Avenida|Plaza|Paseo) (?:de (?:la )?)?[A-Z][^\W\d_]+,? (?:n\.º )?\d+|(?:ul|al|pl|os)\. [A-Z][^\W\d_]+(?: [A-Z][^\W\d_]+)? \d+(?:/\d+)?)"
)
ADDRESS_LIKE = re.compile(rf"\d [A-Z][^\W\d_]+ (?:[A-Z][^\W\d_]+ )*{EN_KIND}|(?:gasse|straße|strasse|str\.|weg|platz|allee|ring|damm|ufer) \d|(?:ул|вул|пер|пров|просп|пр|пл|наб)\.|улиц|вулиц|переул|провул|проспект|площ|бульвар|набереж|\d,? (?:rue|avenue|boulevard|place|quai) |Calle |Avenida |Plaza |Paseo |(?:ul|al|pl|os)\. [A-Z]")
# Pieces of lower-case text without which there is no mention of a kind; one pass finds them all.
ID_PIECES = "ssn|security|passport|паспорт|insurance|ni n|licen|tax id|инн|іпн|рнокпп|снилс|номер|id card|identity|personal id|ausweis|steuer|pesel|dni|водител".split("|")
STREET_KINDS = "street st avenue ave road rd lane ln boulevard blvd close drive dr court ct way place square terrace crescent".split()
ADDRESS_PIECES = "gasse |straße |strasse |str. |weg |platz |allee |ring |damm |ufer |ул.|вул.|пер.|пров.|просп.|пр.|пл.|наб.|улиц|вулиц|переул|провул|проспект|площ|бульвар|набереж|rue |calle |avenida |plaza |paseo |ul. |al. |pl. |os. |avenue |quai ".split("|")


def _pieces() -> ahocorasick.Automaton:
    kinds: dict[str, int] = {}

    def put(words, bit: int) -> None:
        for w in words:
            kinds[w] = kinds.get(w, 0) | bit

    digits, letters = "0123456789", "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщэюяіїєґё"
    put((*(f"00{d}" for d in digits), *(f"{a}{x}{b}" for a in digits for b in digits for x in " \u00a0/")), 4)
    put((f"{a}{w}{x}" for a in " \n\t\"'(«*>" for w in CUE_TITLES for x in ". \u00a0"), 16)
    put(CUE_PHRASES, 16)
    put(("@", "at]", "at)", "at ]", "at )"), 1)
    put(ID_PIECES, 2)
    put([*(f"+{d}" for d in digits), *(f"({d}" for d in digits), "00 ", *(f"{a}{s}{b}" for a in digits for b in digits for s in ".-‐‑")], 4)
    put([*ADDRESS_PIECES, *(f" {k}{x}" for k in STREET_KINDS for x in " .,\n")], 8)
    put([*GENDER, *STEMS, *(f"{a}{x}." for a in " \n\t\"'(<|«=" for x in letters)], 16)
    auto = ahocorasick.Automaton()
    for w, bits in kinds.items():
        auto.add_word(w, bits)
    auto.make_automaton()
    return auto


PIECES = _pieces()


def _is_family(word: str, like: str) -> bool:
    low = word.lower()
    if len(word) < 2 or low in NOT_FAMILY:
        return False
    if like.islower():
        return len(word) > 2 and low == word and FAMILY_END.search(word) is not None
    return word[0].isupper()


def persons(text: str, taken: list[tuple[int, int]], maybe: list[tuple[int, int, str, str]] | None = None) -> list[tuple[int, int, str, str]]:
    """start, end, given name or initial, family name of each person; taken spans are passed over. A listed given name and
    another word, both in lower case, go to maybe: the corpus may know the word as a family name."""
    toks = [(*m.span(), m.group()) for m in WORD.finditer(text)]
    if taken:
        toks = [t for t in toks if not any(a < t[1] and t[0] < b for a, b in taken)]
    out, i, n = [], 0, len(toks)

    def gap(j: int) -> str:
        return text[toks[j][1] : toks[j + 1][0]]

    def bare(j: int) -> tuple[int, str]:
        w, e = toks[j][2], toks[j][1]
        if w[-2:] in ("'s", "’s"):
            w, e = w[:-2], e - 2
        return e, w

    def letter(j: int) -> bool:
        return len(toks[j][2]) == 1 and toks[j][2].isupper() and text[toks[j][1] : toks[j][1] + 1] == "."

    cued = {m.end() for m in CUE.finditer(text)}

    def given_at(j: int) -> bool:
        w = toks[j][2]
        if w.lower() in GENDER:
            return not (w.islower() and w.lower() in CASED)
        if w[0].isupper() and base_given(w.lower()):
            return True
        return toks[j][0] in cued and len(w) > 1 and w[0].isupper() and w.lower() not in NOT_FAMILY and w.lower() not in CUE_TITLES

    while i < n:
        a, end, w = toks[i]
        low = w.lower()
        # most words begin no name in any of the ways below
        if not (low in GENDER or len(w) == 1 or a in cued or text[end : end + 1] == "," or "А" <= w[0] <= "Я" and base_given(low) or w[0] in "ІЇЄҐ" and base_given(low)):
            i += 1
            continue
        if i + 1 < n and given_at(i):
            j = i + 1
            if letter(j) and GAP.fullmatch(gap(i)) and j + 1 < n and GAP.fullmatch(gap(j)[1:]):
                ok, j = True, j + 1
            else:
                ok = GAP.fullmatch(gap(i)) is not None
                if ok and j + 1 < n and w[0].isupper() and base_given(toks[j][2].lower()) and gap(j) == " " and _is_family(bare(j + 1)[1], w) and toks[j + 1][2].lower() not in FIRST:
                    j += 1
            if ok:
                e, fam = bare(j)
                opens = low in OPENERS and re.search(r"(?:^|[.!?:;…\n])[\"'»“(*\s\-]*$", text[max(a - 6, 0) : a]) is not None
                if _is_family(fam, w) and fam.lower() not in FIRST and not (opens and not FAMILY_END.search(fam.lower())):
                    given = base_given(low) or low
                    out.append((a, e, given, base_family(fam.lower(), GENDER.get(given))))
                    i = j + 1
                    continue
                if maybe is not None and w.islower() and fam.islower() and len(fam) > 2 and fam not in NOT_FAMILY and base_given(fam) is None:
                    maybe.append((a, e, low, fam))
        if i + 1 < n and gap(i) in (", ", ",\n") and w[0].isupper() and _is_family(w, w) and low not in FIRST:
            nxt = toks[i + 1][2]
            if bare(i + 1)[1].lower() in GENDER and not nxt.islower():
                e, given = bare(i + 1)
                if i + 2 < n and letter(i + 2) and GAP.fullmatch(gap(i + 1)):
                    e = toks[i + 2][1] + 1
                out.append((a, e, given.lower(), low))
                i += 2
                continue
            if letter(i + 1) and (len(w) > 3 or low in SHORT_FAMILY):
                out.append((a, toks[i + 1][1] + 1, nxt.lower() + ".", low))
                i += 2
                continue
        if letter(i) and i + 1 < n and re.fullmatch(r"\.[  ]?", gap(i)):
            j = i + 1
            if letter(j) and j + 1 < n and re.fullmatch(r"\.[  ]?", gap(j)):
                j += 1
            e, fam = bare(j)
            if (len(fam) > 3 or j > i + 1 or fam.lower() in SHORT_FAMILY) and _is_family(fam, "X") and not letter(j):
                out.append((a, e, low + ".", fam.lower()))
                i = j + 1
                continue
        if low in GENDER and w.islower() and i > 0 and gap(i - 1) == ", " and toks[i - 1][2].islower() and FAMILY_END.search(toks[i - 1][2]) and (not out or out[-1][1] <= toks[i - 1][0]):
            out.append((toks[i - 1][0], bare(i)[0], low, toks[i - 1][2]))
        i += 1
    return out


def _found(text: str) -> tuple[list[tuple[str, int, int, str, str, str]], list[tuple[int, int, str, str]]]:
    """kind, start, end, normal form, given and family name of every mention; and start, end and words of what may be a
    name in lower case."""
    found: list[tuple[str, int, int, str, str, str]] = []
    maybe: list[tuple[int, int, str, str]] = []

    def add(kind: str, a: int, b: int, norm: str, given: str = "", fam: str = "") -> None:
        if not any(x < b and a < y for _, x, y, *_ in found):
            found.append((kind, a, b, norm, given, fam))

    near = 0
    for _, bits in PIECES.iter("\n" + text.lower() + "\n"):
        near |= bits
    if near & 1:
        for m in EMAIL.finditer(text):
            add("email", m.start(), m.end(), re.sub(r" ?[\[(] ?dot ?[\])] ?", ".", re.sub(AT, "@", m.group().lower())).replace(" ", ""))
    if near & 2:
        for m in ID.finditer(text):
            add("id_number", m.start(1), m.end(1), re.sub(r"[\W_]", "", m.group(1)).lower())
    if near & 4:
        for m in PHONE.finditer(text):
            add("phone", m.start(), m.end(), re.sub(r"\D", "", re.sub(r"^00(?: |(?=[1-9]))", "+", m.group())))
    if near & 8 and ADDRESS_LIKE.search(text):
        for m in ADDRESS.finditer(text):
            add("address", m.start(), m.end(), re.sub(r"[\W_]+", " ", m.group()).strip().lower())
    if near & 16:
        people = persons(text, [(a, b) for _, a, b, *_ in found], maybe)
        full = {(fam, given[0]): given for _, _, given, fam in people if not given.endswith(".")}
        for a, b, given, fam in people:
            # an initial stands for the full name of the same text, if one fits
            add("person", a, b, f"{full.get((fam, given[0]), given)} {fam}", full.get((fam, given[0]), given), fam)
    return sorted(found, key=lambda x: x[1]), [m for m in maybe if not any(x < m[1] and m[0] < y for _, x, y, *_ in found)]


def mentions(text: str) -> list[tuple[str, int, int, str]]:
    """kind, start, end (in characters) and normal form of every mention that a text shows by itself, in order, without overlap."""
    return [x[:4] for x in _found(text)[0]]


UPPER = "A-ZÀ-ÖØ-ÞĄĆČĘŁŃŚŠŹŻŽА-ЯЁІЇЄҐ"
PAIR = re.compile(rf"(?<![\w@./#\-])([{UPPER}][^\W\d_]+)[ \u00a0](?=([{UPPER}][^\W\d_]+(?:-[^\W\d_]{{2,}})?)(?![\w@/]))")


def likely(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """start, end, given, family of two capitalised words that may be a name if the corpus says so; taken spans are passed over."""
    out = []
    for m in PAIR.finditer(text):
        g, f = m.group(1), m.group(2)
        low, a, b = g.lower(), m.start(), m.end(2)
        if g[1:].islower() and not f.isupper() and low not in NOT_FAMILY and f.lower() not in NOT_FAMILY and low not in CUE_TITLES and base_given(low) is None and not any(x < b and a < y for x, y in taken):
            out.append((a, b, low, f.lower()))
    return out


MENTION = "kind string, a int, b int, norm string, given string, fam string"


def _detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        rows = []
        for table, rec, h, text in zip(d["rec_table"], d["rec_id"], d["h"], d["text"], strict=True):
            found, small = _found(text)
            rows += [(table, rec, h, *m) for m in found]
            big = likely(text, [(a, b) for _, a, b, *_ in found])
            rows += [(table, rec, h, kind, a, b, f"{g} {f}", g, f) for kind, pairs in (("capitals", big), ("small", small)) for a, b, g, f in pairs]
        yield pd.DataFrame(rows, columns=["rec_table", "rec_id", "h", "kind", "a", "b", "norm", "given", "fam"])


def records(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """rec_table, rec_id, text of both tables; rows without id or text are left out."""
    m = messages.select(F.lit("messages").alias("rec_table"), F.col("id").cast("string").alias("rec_id"), F.col("content").cast("string").alias("text"))
    s = sessions.select(F.lit("sessions").alias("rec_table"), F.col("id").cast("string").alias("rec_id"), F.col("user_prompt").cast("string").alias("text"))
    return m.unionByName(s).where("rec_id is not null and text <> ''")


LEAST_FAMILIES = 2  # known family names that a learned given name stands before
LEAST_SHARE = 0.5  # of all the capitalised words that it stands before


def detected(df: DataFrame) -> DataFrame:
    """Mentions in rows of rec_table, rec_id, text: rec_table, rec_id, h (hash of the text), kind, a, b (characters), norm.

    Every text is read whole and once; what it shows by itself and what may be a name go to the checkpoint folder, and
    counts over the whole corpus decide on the latter. Null and empty texts hold nothing, an empty table gives no rows.
    """
    x = df.where("text <> ''").select("rec_table", "rec_id", F.xxhash64("text").alias("h"), "text")
    rows = checkpointed(x.mapInPandas(_detect, f"rec_table string, rec_id string, h bigint, {MENTION}").distinct())
    sure, pairs = rows.where("kind not in ('capitals', 'small')"), rows.where("kind in ('capitals', 'small')")
    known = sure.where("kind = 'person'").groupBy("fam").agg(F.count("*").alias("times"))
    met = pairs.join(known, "fam", "left")
    given = met.where("kind = 'capitals'").groupBy("given").agg(F.countDistinct(F.when(F.col("times") >= 2, F.col("fam"))).alias("known"), F.countDistinct("fam").alias("every"))
    given = given.where((F.col("known") >= LEAST_FAMILIES) & (F.col("known") >= LEAST_SHARE * F.col("every"))).join(known.select(F.col("fam").alias("given")), "given", "left_anti")
    learned = met.where("kind = 'capitals'").join(given.select("given"), "given", "left_semi").unionByName(met.where("kind = 'small' and times >= 2"))
    cols = ["rec_table", "rec_id", "h", "kind", "a", "b", "norm"]
    return sure.select(*cols).unionByName(learned.withColumn("kind", F.lit("person")).select(*cols))


# --- surrogates -----------------------------------------------------------------------------------------------------
# Syllables that invented families, mail names and streets are built from.
LATIN_SYLLABLES = "bar den fal gor hal jen kel lor mar nor pel ren sal tor vel wen".split()
CYRILLIC_SYLLABLES = "бар вел гор дол жен зим кал лор мер нав пол рус сел тор фед хар".split()


def _stream(key: bytes, *parts: str):
    """Endless keyed numbers."""
    i = 0
    while True:
        yield from hmac.new(key, "\x1f".join((*parts, str(i))).encode(), hashlib.sha256).digest()
        i += 1


def _coined(r, syllables: list[str], n: int) -> str:
    return "".join(syllables[next(r) % len(syllables)] for _ in range(n))


def _permuted(digits: str, key: bytes, *tweak: str) -> str:
    """Another digit string of the same length: a keyed permutation (Feistel rounds over the two halves), so different
    ones stay different and no check for collisions is needed."""
    u = len(digits) // 2
    a, b = digits[:u], digits[u:]
    for i in range(10):
        if a:
            draw = hmac.new(key, "\x1f".join((*tweak, str(len(digits)), str(i), b)).encode(), hashlib.sha256).digest()
            a = str((int(a) + int.from_bytes(draw[:16])) % 10 ** len(a)).zfill(len(a))
        a, b = b, a
    return a + b


def area_digits(digits: str) -> int:
    """How many first digits of a phone number stay: its country and area code, at least six others being changed."""
    far = re.match(r"2[1-689]|3[578]|42|5[09]|6[789]|8[0578]|9[679]", digits) and len(digits) > 10
    return max(0, min(3 if len(digits) <= 10 else 5 if far else 4, len(digits) - 6))


UKRAINIAN = re.compile(r"[іїєґ]|\b(?:вул|вулиця|пров|провулок|просп|площа|набережна|буд|будинок|смт|м)\b")


def _address(norm: str, r) -> str:
    """An invented address in the form that the language of this one uses."""

    def name(syllables=LATIN_SYLLABLES) -> str:
        return _coined(r, syllables, 3).title()

    n, flat = next(r) * 8 + next(r) % 8 + 1, next(r) % 200 + 1
    if re.search(r"[а-яіїєґё]", norm):
        return f"вул. {name(CYRILLIC_SYLLABLES)}а, буд. {n}, кв. {flat}" if UKRAINIAN.search(norm) else f"ул. {name(CYRILLIC_SYLLABLES)}ая, д. {n}, кв. {flat}"
    if m := re.match(r"[^\W\d_]*?(gasse|straße|strasse|str|weg|platz|allee|ring|damm|ufer) \d", norm):
        return f"{name()}{'straße' if m[1] == 'str' else m[1]} {n}"
    if m := re.match(r"\d{1,4} (rue|avenue|boulevard|place|quai) (?!st\b|street)", norm):
        return f"{n} {m[1]} {name()}"
    if m := re.match(r"(calle|avenida|plaza|paseo) ", norm):
        return f"{m[1].title()} {name()}, {n}"
    if m := re.match(r"(ul|al|pl|os) ", norm):
        return f"{m[1]}. {name()} {n}"
    return f"{n} {name()} Street"


def ranked(kind: str, s: str, rank: int) -> str:
    """A replacement that is taken already, told apart by a hyphen and syllables, which none has by itself."""
    more, cyrillic = "", re.search(r"[а-яіїєґё]", s) is not None
    while rank:
        more, rank = (CYRILLIC_SYLLABLES if cyrillic else LATIN_SYLLABLES)[rank % 16] + more, rank // 16
    if kind == "email":
        return s.replace("@", f"-{more}@")
    return f"{s}-{more}" if kind == "person" else re.sub(r"([^\W\d_]{9,})", lambda m: f"{m[1]}-{more}", s, count=1)


def surrogate(kind: str, norm: str, turn: int, key: bytes) -> str:
    """The replacement of an entity, in normal form; turn > 0 gives another one after a collision."""
    r = _stream(key, kind, norm, str(turn))
    if kind == "person":
        given, _, fam = norm.partition(" ")
        cyrillic = bool(re.search(r"[а-яіїєґё]", norm))
        pools = {("f", False): LATIN_F, ("m", False): LATIN_M, ("f", True): CYRILLIC_F, ("m", True): CYRILLIC_M}
        pool = pools.get((GENDER.get(given, "fm"[next(r) % 2]), cyrillic))
        return f"{pool[next(r) % len(pool)].title()} {_coined(r, CYRILLIC_SYLLABLES if cyrillic else LATIN_SYLLABLES, 4).title()}"
    if kind == "email":
        return f"{_coined(r, LATIN_SYLLABLES, 4)}{next(r) % 100}@example.org"
    if kind in ("phone", "id_number"):
        # letters stay, and of a phone number its country and area code; the other digits are permuted
        digits = "".join(str(int(c)) for c in norm if c.isdecimal())
        fixed = area_digits(digits) if kind == "phone" else 0
        new = iter(digits[:fixed] + _permuted(digits[fixed:], key, kind, str(turn), digits[:fixed]))
        return "".join(next(new) if c.isdecimal() else c.upper() for c in norm)
    return _address(norm, r)


def shaped(surface: str, kind: str, s: str) -> str:
    """A replacement in the form of the text it stands for: case, order, initials, separators."""
    if kind in ("phone", "id_number"):
        digits = [c for c in s if c.isdecimal()]
        # 00 stands for the plus sign, which the normal form leaves out
        new = iter(["0", "0"] * (sum(c.isdecimal() for c in surface) == len(digits) + 2) + digits)
        return "".join(next(new, "0") if c.isdecimal() else c for c in surface)
    if kind == "person":
        given, _, fam = s.partition(" ")
        comma = re.match(r"[^\W\d_\-]+(?:-[^\W\d_]+)*, ", surface)
        short = re.search(r"(?<![^\W_])[^\W\d_]\.", surface) and len(re.findall(r"[^\W\d_]{2,}", surface)) == 1
        given = given[0] + "." if short else given
        s = f"{fam}, {given}" if comma else f"{given} {fam}"
    return s.upper() if surface.isupper() else s.lower() if surface.islower() and kind == "person" else s


def seen_as(kind: str, s: str) -> str:
    """What is left of a replacement in its shortest form: of a person the initial and family name."""
    return f"{s[0]}. {s.partition(' ')[2]}" if kind == "person" else s


def _surrogates(key: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            s = [surrogate(k, n, int(t), key) for k, n, t in zip(d["kind"], d["norm"], d["turn"], strict=True)]
            yield d[["kind", "norm", "turn"]].assign(s=s, seen=[seen_as(k, x).lower() for k, x in zip(d["kind"], s, strict=True)])

    return run


def _occupied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        yield pd.DataFrame({"kind": d["kind"], "norm": d["norm"], "turn": -1, "s": d["norm"], "seen": [seen_as(k, n).lower() for k, n in zip(d["kind"], d["norm"], strict=True)]})


def _ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        yield d[["kind", "norm"]].assign(s=[ranked(k, s, int(r)) if r else s for k, s, r in zip(d["kind"], d["s"], d["r"], strict=True)])


LEAST_FREE = 0.75  # share of the numbers of a form that are none of the run's, from which replacements avoid these


def form_of(kind: str, norm: str) -> tuple[str, float]:
    """A number's form, in which its replacements have it too, and how many numbers there are of it."""
    digits = sum(c.isdecimal() for c in norm)
    left = area_digits("".join(str(int(c)) for c in norm if c.isdecimal())) if kind == "phone" else 0
    out, seen = [], 0
    for c in norm:
        seen += c.isdecimal()
        out.append("#" if c.isdecimal() and seen > left else c)
    return "".join(out), 10.0 ** (digits - left)


def _formed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        forms = [form_of(k, n) for k, n in zip(d["kind"], d["norm"], strict=True)]
        yield d[["kind", "norm"]].assign(form=[f for f, _ in forms], room=[n for _, n in forms])


def numbers(ents: DataFrame, key: bytes) -> DataFrame:
    """kind, norm, s for phones and id numbers, distinct: a keyed permutation of the digits, and another one while the
    result is a number of the run or taken. Where the run holds more than a quarter of a form's numbers, the first
    permutation stands, as it keeps numbers apart by itself. The rounds end, as each settles half of the rest at least.
    """
    draw, drawn = _surrogates(key), "kind string, norm string, turn int, s string, seen string"
    formed = checkpointed(ents.mapInPandas(_formed, "kind string, norm string, form string, room double"))
    full = formed.groupBy("kind", "form").agg((F.count("*") > (1 - LEAST_FREE) * F.max("room")).alias("full"))
    x = formed.join(full, ["kind", "form"])
    done = x.where("full").select("kind", "norm", F.lit(0).alias("turn")).mapInPandas(draw, drawn).select("kind", "norm", "s", "seen")
    real = formed.select("kind", F.lower("norm").alias("seen"))
    todo, turn = x.where("not full").select("kind", "norm"), 0
    while not todo.isEmpty():
        step = todo.withColumn("turn", F.lit(turn)).mapInPandas(draw, drawn).select("kind", "norm", "s", "seen")
        good = checkpointed(step.join(real.unionByName(done.select("kind", "seen")), ["kind", "seen"], "left_anti").select("kind", "norm", "s", "seen"))
        todo, done, turn = checkpointed(todo.join(good, ["kind", "norm"], "left_anti")), done.unionByName(good), turn + 1
    return done.select("kind", "norm", "s")


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """kind, norm, s: one replacement per distinct entity, distinct within its kind in every form that shaped() gives it,
    and none that is an entity of found itself.

    Numbers are permuted within their form. Of other entities that drew one replacement, or that of a real entity, all but
    the first by normal form draw again with their rank, and what still collides after that gets its rank in syllables.
    """
    drawn = "kind string, norm string, turn int, s string, seen string"
    draw = _surrogates(key.encode())
    ents = found.select("kind", "norm").distinct()
    digits = F.col("kind").isin("phone", "id_number")
    texts = ents.where(~digits)
    real = texts.mapInPandas(_occupied, drawn)
    one = texts.withColumn("turn", F.lit(0)).mapInPandas(draw, drawn).unionByName(real).withColumn("k", F.row_number().over(Window.partitionBy("kind", "seen").orderBy("turn", "norm")) - 1).where("turn >= 0")
    again = one.where("k > 0").select("kind", "norm", F.col("k").alias("turn")).mapInPandas(draw, drawn).withColumn("turn", F.lit(1))
    rank = F.row_number().over(Window.partitionBy("kind", "seen").orderBy("turn", "norm")) - 1
    both = one.where("k = 0").drop("k").unionByName(again).unionByName(real).withColumn("r", rank).where("turn >= 0")
    return both.select("kind", "norm", "s", "r").mapInPandas(_ranked, "kind string, norm string, s string").unionByName(numbers(ents.where(digits), key.encode()))


def _rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        texts, typed = [], []
        for t, ms in zip(d["text"], d["ms"], strict=True):
            out, tags, at = [], [], 0
            for m in sorted(ms, key=lambda x: x["a"]):
                out += [t[at : m["a"]], shaped(t[m["a"] : m["b"]], m["kind"], m["s"])]
                tags += [t[at : m["a"]], f"[{m['kind'].upper()}_{m['tag']}]"]
                at = m["b"]
            texts.append("".join([*out, t[at:]]))
            typed.append("".join([*tags, t[at:]]))
        yield d[["rec_table", "rec_id"]].assign(surrogate_text=texts, placeholder_text=typed)


def anonymised(df: DataFrame, key: str) -> DataFrame:
    """rec_table, rec_id, surrogate_text, placeholder_text for the rows that hold personal data.

    Placeholders are the kind and a keyed tag of the entity, so they tell entities apart as the surrogates do. The
    parts of a text outside its mentions stay as they are. Equal rows give one row each; ties do not matter.
    """
    found = detected(df)
    tag = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "norm"), 256), 1, 8)
    x = found.join(surrogates(found, key), ["kind", "norm"]).withColumn("tag", tag)
    ms = x.groupBy("rec_table", "rec_id", "h").agg(F.collect_set(F.struct("a", "b", "kind", "s", "tag")).alias("ms"))
    texts = df.where("text <> ''").select("rec_table", "rec_id", F.xxhash64("text").alias("h"), "text").distinct()
    return texts.join(ms, ["rec_table", "rec_id", "h"]).select("rec_table", "rec_id", "text", "ms").mapInPandas(_rewrite, "rec_table string, rec_id string, surrogate_text string, placeholder_text string")


def p2_found(spark, sf_dir):
    """One row for each mention."""
    found = detected(records(read_table(spark, sf_dir, "messages"), read_table(spark, sf_dir, "sessions")))
    return found.select("rec_table", "rec_id", "kind", F.col("a").cast("bigint").alias("pii_start")).distinct()


def p2_anonymised(spark, sf_dir, key: str = "a key that the caller keeps"):
    """The texts that hold personal data, with surrogates and with placeholders in its place."""
    return anonymised(records(read_table(spark, sf_dir, "messages"), read_table(spark, sf_dir, "sessions")), key)


QUERIES = {"p2_found": p2_found, "p2_anonymised": p2_anonymised}
