"""Word lists, code sets, markers and patterns.

Nothing here is derived; changing a value changes results.
"""

# English stop words: the list Spark's StopWordsRemover loads for "english".
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before
after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now
i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm
you're he's she's it's we're they're i've we've you've they've isn't aren't
wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()

# Semantic types kept in the `sg` (semantic group) concept set.
SEMANTIC_GROUP_TUIS = """
T017 T018 T019 T020 T021 T022 T023 T024 T025 T026 T029 T030 T031 T033 T034 T037
T038 T046 T047 T048 T049 T050 T058 T059 T060 T061 T062 T063 T065 T067 T068 T069
T070 T103 T104 T109 T114 T116 T120 T121 T122 T123 T125 T126 T127 T129 T130 T131
T184 T190 T191 T192 T195 T196 T197 T200
""".split()

# Semantic types kept in the `st` (semantic type) concept set.
SEMANTIC_TYPE_TUIS = """
T017 T022 T023 T033 T034 T047 T048 T049 T059 T060 T061 T121 T122 T123 T184
""".split()

# Coding schemes whose codes get a one-letter prefix.
SCHEME_PREFIX = {"SNOMEDCT": "S", "RXNORM": "R"}
SNOMED_SCHEME = "SNOMEDCT"

# Value written for a note without annotations.
NO_ANNOTATION = "N"

# Record markers around a note, and literal markup dropped by note cleanup.
RECORD_START = "START_OF_RECORD=1||||1||||"
RECORD_END = "||||END_OF_RECORD"
NOTE_MARKUP = ["<br />", "<p>", "</p>", "<b>", "</b>"]

# ASCII punctuation and digits removed by text normalisation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DIGITS = "0123456789"

# Annotation XML element names (UIMA CAS).
CAS_ROOT = "CAS"
CAS_TEXT = "uima.cas.Sofa"
CAS_CONCEPT = "org.apache.ctakes.typesystem.type.refsem.UmlsConcept"

# Pipe-delimited concept lines start with this.
CONCEPT_LINE_PREFIX = "00000000|MMI|"

# Columns of the headerless cohort metadata table.
COHORT_DDL = (
    "fname string, empi string, date date, author string, before2012 string, "
    "noContent string, authorLast string, authorFirst string, spId string, "
    "spDesc string, sex string, age int, sp int, unk string, refer string, label string"
)
NOTES_DDL = "fname string, bow string, snomed string, umls string, sg string, st string"
TEXT_NOTES_DDL = "fname string, bow string"

# The word in slot 0 of every dictionary.
RARE_WORD = "RARE"

# Typed placeholders for personal data, in order of application. The patterns
# use only syntax shared by Java and RE2.
PHI_RULES = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("URL", r"https?://[^\s<>]+"),
    ("IP", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("DATE", r"\b([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})\b"),
    ("SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("PHONE", r"(\+[0-9]{1,2}[ .-])?(\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b"),
    ("CARD", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"),
    ("ID", r"\b[0-9]{7,}\b"),
]
PLACEHOLDER_PATTERN = r"\[\*\*[^\]]*\*\*\]"

# Named HTML entities decoded by html_text (besides numeric ones and &amp;).
HTML_ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'",
    "copy": "©", "reg": "®", "trade": "™", "middot": "·",
    "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "laquo": "«", "raquo": "»", "deg": "°", "plusmn": "±",
    "micro": "µ", "times": "×", "divide": "÷", "euro": "€",
    "pound": "£", "sect": "§", "para": "¶", "iexcl": "¡",
    "iquest": "¿", "szlig": "ß", "auml": "ä", "ouml": "ö",
    "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü",
    "agrave": "à", "aacute": "á", "acirc": "â", "atilde": "ã",
    "aring": "å", "aelig": "æ", "ccedil": "ç", "egrave": "è",
    "eacute": "é", "ecirc": "ê", "euml": "ë", "igrave": "ì",
    "iacute": "í", "icirc": "î", "iuml": "ï", "ntilde": "ñ",
    "ograve": "ò", "oacute": "ó", "ocirc": "ô", "ugrave": "ù",
    "uacute": "ú", "ucirc": "û",
}

# Porter's suffix rules (M. F. Porter, "An algorithm for suffix stripping", 1980).
PORTER_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance",
    "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
PORTER_STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
PORTER_STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
).split()

# Smoothing constant of the clipped batch metrics and the attention pools.
EPSILON = 1e-7

# What a field of a tab-separated file may not hold, and how it is written there; the backslash comes first.
TSV_ESCAPES = [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")]
TSV_NULL = "\\N"
