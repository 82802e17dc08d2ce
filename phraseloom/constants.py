"""Lists and limits that results depend on."""

from __future__ import annotations

# Abbreviations that keep their dot, lower case.
ABBREVIATIONS = (
    "mr mrs ms dr drs prof sr jr st sts rev capt gen lt col sgt cpl cmdr gov sen rep pres supt det atty ofc mt pvt "
    "inc corp co ltd llc plc bros assn dept univ intl conf "
    "jan feb mar apr jun jul aug sep sept oct nov dec "
    "mon tue tues wed thu thur thurs fri sat sun "
    "etc vs ie eg cf al viz ca ibid et circa "
    "no nos vol ch pp pg fig figs ed eds trans sec approx wkly mo yr yrs ave blvd rd ln pl ft ext "
    "ala ariz ark calif colo conn del fla ga ill ind kan ky la mass mich minn miss mont neb nev okla ore pa tenn tex va "
    "vt wash wis wyo ont que alb "
    "aplo arrv attn dom ect esp eve fax info lb lv mins mob oz para ph pop ps rec reps spec wa est"
).split()

# Prefixes that stay joined to the word after their hyphen.
PREFIXES = (
    "co non anti pre post mid pro e ex mis counter semi sub super re un multi inter intra trans over under self near all cross pseudo quasi neo"
).split()

# Placeholder words of headwords.
SLOT_WORDS = (
    "one's ones one oneself someone someone's somebody somebody's something sb sb's sth sth's sw your yours yourself pron poss x y z"
).split()
PRONOUN_SLOTS = "one's ones one oneself someone's somebody's sb's poss your yours yourself pron someone somebody sb".split()
NOUN_SLOTS = "something sth sth's sw".split()

# Words without content of their own.
CLOSED_CLASS = (
    "a an the of in on at to for with by from up out off over under into onto upon about as per via vs and or but nor so yet if than not no its it be"
).split()
CONNECTORS = ("or", "and", "nor")
CLITICS = ("'s", "’s", "'", "’")

# Characters stripped from both ends before lemmatising.
STRIP_CHARS = "\"'’.,;:!?()[]{}<>"

# Irregular forms, form:lemma.
IRREGULAR = dict(
    pair.split(":")
    for pair in (
        "brought:bring bought:buy caught:catch taught:teach thought:think sought:seek fought:fight went:go gone:go took:take taken:take "
        "came:come gave:give given:give got:get gotten:get made:make kept:keep left:leave lost:lose found:find held:hold broke:break "
        "broken:break spoke:speak spoken:speak drew:draw drawn:draw blew:blow blown:blow threw:throw thrown:throw knew:know known:know "
        "grew:grow grown:grow flew:fly flown:fly drove:drive driven:drive rose:rise risen:rise fell:fall fallen:fall ran:run sat:sit "
        "stood:stand understood:understand won:win sent:send spent:spend built:build lit:light led:lead fed:feed bled:bleed bit:bite "
        "hid:hide hidden:hide rode:ride ridden:ride wrote:write written:write shook:shake shaken:shake stole:steal stolen:steal "
        "swore:swear sworn:swear tore:tear torn:tear wore:wear worn:wear bore:bear borne:bear chose:choose chosen:choose froze:freeze "
        "frozen:freeze began:begin begun:begin drank:drink drunk:drink sang:sing sung:sing swam:swim swum:swim rang:ring rung:ring "
        "sank:sink sunk:sink sprang:spring sprung:spring dealt:deal meant:mean felt:feel slept:sleep wept:weep swept:sweep crept:creep "
        "leapt:leap knelt:kneel dwelt:dwell bound:bind wound:wind ground:grind paid:pay laid:lay said:say fled:flee done:do does:do "
        "did:do had:have has:have men:man women:woman children:child feet:foot teeth:tooth geese:goose mice:mouse people:person "
        "lives:life knives:knife wives:wife leaves:leaf wolves:wolf shelves:shelf halves:half am:be is:be are:be was:be were:be been:be "
        "being:be became:become bent:bend bitten:bite dug:dig ate:eat forgot:forget forgotten:forget forgave:forgive hung:hang lent:lend "
        "lain:lie met:meet sold:sell shone:shine stuck:stick told:tell woke:wake woken:wake swung:swing spun:spin struck:strike "
        "wove:weave woven:weave clung:cling spilt:spill stung:sting stank:stink stunk:stink strove:strive wrung:wring arose:arise "
        "awoke:awake awoken:awake shrank:shrink shrunk:shrink swollen:swell slung:sling slain:slay slew:slay strode:stride "
        "stridden:stride trod:tread trodden:tread shorn:shear withdrew:withdraw overcame:overcome forbade:forbid overtook:overtake "
        "underwent:undergo undertook:undertake upheld:uphold withstood:withstand foresaw:foresee forsook:forsake undid:undo beheld:behold "
        "overslept:oversleep misunderstood:misunderstand overdid:overdo withheld:withhold overthrew:overthrow partook:partake"
    ).split()
)

# Irregular forms of verbs only.
IRREGULAR_VERBS = dict(pair.split(":") for pair in "saw:see shot:shoot smelt:smell spelt:spell spat:spit abode:abide".split())

# Endings that two forms of one lemma may differ by, and the shortest shared stem.
INFLECTIONS = ("s", "es", "ed", "d", "ing", "n", "en", "ies", "ied")
SHORTEST_STEM = 4

# Tokens allowed in a slot, and between two fixed words without one.
SLOT_MAX, GAP_MAX = 4, 1

# Punctuation that no match crosses.
HARD_BOUNDARIES = (";", ":", ".", "!", "?", "…", '"', "'", "’", "“", "”", "‘", "--", "—", "(", ")")
CONTENT_UPOS = ("NOUN", "PROPN", "NUM", "VERB")
NOMINAL_UPOS = ("NOUN", "PROPN", "PRON", "DET")

# White space of Unicode as a regular-expression class body (Java and RE2).
BLANK = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Subword grid.
ROOT_SUBWORD, UNKNOWN_SUBWORD, MAX_SUBWORDS = 1, 3, 20

# Reclassification batches and retry delays.
BATCH_SIZE = 50
RETRY_SECONDS = (2, 4, 8, 16)
RETRYABLE = ("429", "503", "500")

# Morphological categories and their values.
FEATS = {
    "Number": "Sing Plur Ptan",
    "Person": "1 2 3",
    "Tense": "Past Pres",
    "VerbForm": "Fin Inf Part Ger",
    "Mood": "Ind Imp Sub",
    "Voice": "Pass",
    "Degree": "Pos Cmp Sup",
    "Case": "Nom Acc Gen",
    "Gender": "Masc Fem Neut Fem,Masc",
    "PronType": "Art Dem Prs Int Rel Ind Neg Tot Rcp Emp",
    "Definite": "Def Ind",
    "NumType": "Card Ord Mult Frac",
    "NumForm": "Word Digit Roman Combi",
    "Polarity": "Pos Neg",
    "Poss": "Yes",
    "Reflex": "Yes",
    "Abbr": "Yes",
    "Foreign": "Yes",
    "Typo": "Yes",
    "Style": "Arch Coll Expr Slng Vrnc",
    "ExtPos": "ADP ADV CCONJ NOUN PRON PROPN SCONJ",
}

# Forms of tokens, in the order in which they are tried, as regular expressions (Java and RE2); {case} switches
# to matching without regard to case, {abbreviations} and {prefixes} are alternatives of the lists above.
TOKEN_FORMS = (
    rf"https?://[^{BLANK}]+",
    r"www\.[A-Za-z0-9][A-Za-z0-9.\-]*",
    r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+",
    r"(?:[A-Za-z]\.){2,}",
    "({case}:{abbreviations})\\.",
    r"[A-Z]\.",
    r"\p{Nd}+(?:[.,:/]\p{Nd}+)+",
    r"\p{Nd}+(?:-\p{Nd}+){2,}",
    r"['’]\p{Nd}+(?:[A-Za-z]+)?",
    r"\.{2,}",
    r"…",
    r"-{2,}",
    r"\*{2,}",
    "({case}:{prefixes})-[A-Za-z]+(?:['’][A-Za-z0-9]+)*",
    r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)*",
    rf"[^{BLANK}A-Za-z0-9]",
)

# The clitic at the end of a token.
CLITIC_TAIL = r"(?:n['’]t|['’](?:ll|re|ve|s|m|d))"


def token_forms(case: str) -> list[str]:
    """``TOKEN_FORMS`` with the lists filled in, longest abbreviations first."""
    abbreviations = "|".join(sorted(ABBREVIATIONS, key=lambda w: (-len(w), w)))
    fill = lambda form: form.replace("{case}", case).replace("{abbreviations}", abbreviations).replace("{prefixes}", "|".join(PREFIXES))
    return [fill(form) for form in TOKEN_FORMS]
