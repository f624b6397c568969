"""Fixed values.

Word lists, patterns, thresholds and code tables in this file are part of the
behaviour being matched.  They are stated as they are, in their natural order;
no logic lives here.
"""

SAFE_REFUSAL_TEXT = "I cannot answer from the provided context."

# Function words removed from English text by the guardrails.
ENGLISH_FUNCTION_WORDS = tuple(
    "a an and are as at be by did do does for from had has have how in is it of on or "
    "that the this to was were what when where which who why with".split()
)

# Question words and copulas of other languages, removed by answer selection as
# well.  Negations are deliberately absent.
OTHER_FUNCTION_WORDS = tuple(
    "कब कहाँ कहा क्या कौन कैसे क्यों है हैं का की के में कुत्र अस्ति आहे कुठे छ "
    "কোথায় কি কী আছে எங்கே என்ன உள்ளது ఎక్కడ ఏమి ఉంది ಎಲ್ಲಿ ಎಲ್ಲಿದೆ ಏನು ಇದೆ "
    "എവിടെ എവിടെയാണ് എന്ത് ആണ് ક્યારે ક્યાં કયાં શું છે کہاں کیا ہے କେଉଁଠି କଣ ଅଛି "
    "ਕਿੱਥੇ ਕੀ ਹੈ".split()
)
SELECTION_FUNCTION_WORDS = ENGLISH_FUNCTION_WORDS + OTHER_FUNCTION_WORDS

# A claim with one of these (or any number) needs the same token in its evidence.
NEGATION_TOKENS = ("no", "not", "never", "without")

# Opposite poles: a question token on one side and a sentence token on the other
# side of the same group is a conflict.
ANTONYM_GROUPS = (
    (
        tuple(
            "low lower lowest minimum कम निम्न न्यूनतम குறைவு குறைந்த குறைவுள்ள குறைவான کم کمترین".split()
        ),
        tuple(
            "high higher highest maximum अधिक उच्च अधिकतम அதிக அதிகம் உயர்ந்த زیادہ اعلی اعلیٰ بلند".split()
        ),
    ),
    (
        tuple("before earlier पहले पूर्व முன் پہلے".split()),
        tuple("after later बाद पश्चात பின் بعد".split()),
    ),
    (
        tuple("increase increased rising बढ़ा बढ़ी அதிகரித்தது اضافہ بڑھا".split()),
        tuple("decrease decreased falling घटा घटी குறைந்தது کمی گھٹا".split()),
    ),
)

QUANTITY_QUESTION_TOKENS = tuple(
    "howmany many number count कितना कितनी कितने संख्या नंबर எத்தனை எண் எண்ணிக்கை "
    "کتنا کتنی کتنے تعداد نمبر".split()
)
NUMBER_WORDS = tuple(
    "zero one two three four five six seven eight nine ten "
    "शून्य एक दो तीन चार पांच पाँच छह सात आठ नौ दस "
    "பூஜ்ஜியம் ஒன்று இரண்டு மூன்று நான்கு ஐந்து ஆறு ஏழு எட்டு ஒன்பது பத்து "
    "صفر ایک دو تین چار پانچ چھ سات آٹھ نو دس".split()
)

# Input-safety rules: (category, rule, pattern), first match wins.
UNSAFE_RULES = (
    (
        "prompt_injection",
        "instruction_override",
        r"\b(?:ignore|disregard|override)\b.{0,48}"
        r"\b(?:previous|prior|system|developer|instructions?|prompt)\b",
    ),
    (
        "prompt_injection",
        "secret_extraction",
        r"\b(?:reveal|show|print|leak|expose)\b.{0,48}"
        r"\b(?:system prompt|developer message|api[- ]?key|secret|credentials?)\b",
    ),
    (
        "prompt_injection",
        "jailbreak",
        r"\b(?:jailbreak|do anything now|developer mode)\b",
    ),
    (
        "harmful",
        "weapon_construction",
        r"\b(?:build|make|create|assemble)\b.{0,48}\b(?:bomb|explosive|weapon)\b",
    ),
    (
        "harmful",
        "credential_theft",
        r"\b(?:steal|phish|exfiltrate|harvest)\b.{0,48}"
        r"\b(?:passwords?|credentials?|api[- ]?keys?)\b",
    ),
    (
        "harmful",
        "physical_harm",
        r"\b(?:kill|murder|poison)\b.{0,32}\b(?:a person|people|someone|somebody)\b",
    ),
    (
        "inappropriate",
        "sexual_content_involving_minors",
        r"\b(?:sexual|explicit|pornographic)\b.{0,40}\b(?:child|children|minor|minors)\b",
    ),
)
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{202a}-\x{202e}\x{2066}-\x{2069}]"

# Text patterns.
CITATION = r"\[chunk:([^\]\s]+)\]"
SENTENCE_ENDS = ".!?。！？।॥"
CHUNK_BOUNDARY = r"(?:\n\s*\n|[.!?;:।॥]\s+|\n|,\s+)"
MARKDOWN_PREFIX = r"^\s*(?:[-*+]\s+|#{1,6}\s+|\d+[.)]\s+)"
SAFE_CITATION_ID = r"^[^\]\s]+$"

# Language code -> (name, three-letter file stem).
LANGUAGES = {
    "as": ("Assamese", "asm"),
    "bn": ("Bengali", "ben"),
    "gu": ("Gujarati", "guj"),
    "hi": ("Hindi", "hin"),
    "kn": ("Kannada", "kan"),
    "ml": ("Malayalam", "mal"),
    "mr": ("Marathi", "mar"),
    "ne": ("Nepali", "nep"),
    "or": ("Odia", "ori"),
    "pa": ("Punjabi", "pan"),
    "sa": ("Sanskrit", "san"),
    "ta": ("Tamil", "tam"),
    "te": ("Telugu", "tel"),
    "ur": ("Urdu", "urd"),
}
LANGUAGE_ALIASES = {stem: code for code, (_, stem) in LANGUAGES.items()} | {"pun": "pa"}

# Corpus record fields.
META_FIELDS = (
    "model_name",
    "temperature",
    "max_tokens",
    "top_p",
    "frequency_penalty",
    "presence_penalty",
)
RECORD_FIELDS = (
    "source_lang",
    "target_lang",
    "meta",
    "query",
    "Answer",
    "query_id",
    "query_type",
    "passages",
    "Eng_Query",
    "Eng_Answer",
)
SUMMARY_PERCENTILES = (0, 25, 50, 70, 75, 90, 95, 99, 100)
REPORT_PERCENTILES = (50, 70)

# Domains.
STATUSES = ("answered", "refused")
REFUSAL_REASONS = (
    "unsafe_input",
    "off_topic",
    "no_relevant_context",
    "ambiguous_retrieval",
    "generation_invalid_output",
    "latency_budget_exhausted",
    "ungrounded_answer",
    "upstream_failure",
)
EVAL_SAMPLE_FIELDS = (
    "audio",
    "reference",
    "expected_status",
    "expected_refusal_reason",
    "expected_answer_contains",
    "expected_chunk_ids",
    "expected_document_ids",
)

# Gate limits.
MIN_FULL_SCORE = 0.58
STRONG_FULL_SCORE = 0.68
MIN_COVERAGE = 0.34
STRONG_COVERAGE = 0.60
RELEVANCE_EPSILON = 1e-4
SCORE_BOUND = 1.0001
MIN_SUPPORT = 0.80
AMBIGUOUS_SUPPORT = 0.60
MIN_JUDGE_BUDGET_MS = 75.0
SELECTION_MIN_SCORE = 0.68
SELECTION_MIN_COVERAGE = 0.60
SELECTION_MIN_MARGIN = 0.08
SELECTION_MIN_TOKENS = 2
SELECTION_MAX_CHARS = 600
SELECTION_SCORE_WEIGHT = 0.20
SELECTION_SPECIFICITY_WEIGHT = 0.10
SELECTION_EPSILON = 1e-6
MIN_FALLBACK_BUDGET_MS = 350.0
CHUNK_CHARACTERS = 600
CHUNK_OVERLAP_CHARACTERS = 100
CHUNK_TOKENS = 192
CHUNK_OVERLAP_TOKENS = 32
WINDOW_TOKENS = 8192 - 2
MIN_WORKLOAD = 30
MAX_QUERY_CHARS = 2000
MAX_FINAL_K = 100
MAX_CANDIDATE_K = 1000
SESSIONS_PER_WINDOW = 6
ADMISSION_WINDOW_SECONDS = 60.0
MAX_FRAME_BYTES = 16000
TURN_GRACE_SECONDS = 2.0
