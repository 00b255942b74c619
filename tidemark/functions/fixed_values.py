"""Fixed values of the data model: domains, slots, cue patterns. Results depend on them as they stand."""

# Fixed values.
EVENT_TYPES = ("dial_attempt", "disposition", "bot_transcript", "field_visit", "contact_point_update", "payment")
NETWORK_RESPONSES = ("answered", "no_answer", "busy", "switched_off", "not_reachable", "does_not_exist", "immediate_hangup")
DISPOSITIONS = ("rpc", "wrong_number", "third_party", "switched_off", "not_reachable", "promise_to_pay", "dispute", "callback")
RPC_DISPOSITIONS = ("rpc", "promise_to_pay", "callback", "dispute")
VISIT_OUTCOMES = ("locked_premises", "nobody_of_that_name", "met_borrower", "met_third_party", "address_not_found")
SOURCES = ("KYC", "later_update", "bureau", "borrower_on_call", "skip_trace")
WINDOWS_DAYS = (1, 3, 7, 14, 30)
SLOTS = {"morning": (8, 12), "afternoon": (12, 16), "evening": (16, 19)}
SHORT_RING_SECONDS = 3.0
TIMEZONE = "Asia/Kolkata"
HOLIDAYS = ("2026-08-15", "2026-10-02", "2026-11-08")

# Fixed values.
HIDDEN_COLUMNS = ("ground_truth", "true_state", "true_avoidance", "true_borrower_avoidance", "shared_reason", "policy_action")

# Fixed values.
SWITCHED_OFF_CUE = (
    r"n[au]mb[ae]r\s*b[ae]?ndh?\s*(hai|he|h)",
    r"phone\s*b[ae]?ndh?\s*(hai|he|h)",
    r"mobile\s*b[ae]?ndh?\s*(hai|he|h)",
    r"switch\s*off\s*(hai|he|h)",
    r"switched\s*off",
    r"switch\s*of\b",
    r"siwtch\s*off",
    r"off\s*ide",
    r"phone\s*off",
    r"set\s*off\s*(hai|he)",
    r"not\s*reachable\s*(hai|he|h|aa\s*raha)",
    r"phone\s*nahi\s*lag\s*raha",
    r"call\s*nahi\s*lag\s*rah[ai]",
)
WRONG_NUMBER_CUE = (
    r"wrong\s*numb[ae]r",
    r"rong\s*numb[ae]r",
    r"galat\s*numb[ae]r",
    r"galt\s*numb[ae]r",
    r"hosa\s*numb[ae]r",
    r"naya\s*numb[ae]r",
    r"kisi\s*aur\s*ka\s*numb[ae]r",
    r"koi\s*aur\s*(hai|bol\s*raha)",
    r"yeh\s*numb[ae]r\s*(mera|hamara)\s*nahi",
    r"mera\s*numb[ae]r\s*nahi",
    r"nobody\s*by\s*that\s*name",
    r"is\s*naam\s*ka\s*koi\s*nahi",
    r"ee\s*hesarina\s*yaaru\s*illa",
    r"customer.*(gottilla|ottilla)",
    r"customer\s*ko\s*nahi\s*jaanta",
    r"says\s*new\s*number",
    r"do\s*not\s*call.*wrong",
)
AVOIDANCE_CUE = (
    r"baad\s*me\s*(call|phone|baat)\s*kar",
    r"matte\s*call",
    r"don'?t\s*call",
    r"do\s*not\s*call",
    r"call\s*m[ae]t\s*kar",
    r"phone\s*m[ae]t\s*kar",
    r"dobara\s*(call|phone)\s*m[ae]t",
    r"time\s*nahi\s*(hai|h)",
    r"paise\s*nahi\s*(hai|hain|denge|dunga)",
    r"phone\s*kaat\s*diya",
    r"call\s*kaat\s*d[ai]",
    r"uthaya\s*nahi.*jaan\s*b[oo]jh",
    r"avoid.*call",
)
THIRD_PARTY_CUE = (
    r"phone\s*u[dt]hay[ae]\s*(bhai|didi|papa|mummy|pati|patni|beta|beti|dost|padosi|rishtedar|boss|bhabhi|uncle|aunty)",
    r"(bhai|didi|papa|mummy|pati|patni|beta|beti|dost|padosi|rishtedar|bhabhi)\s*ne\s*(phone\s*)?u[dt]hay[ae]",
    r"(bhai|didi|papa|mummy|pati|patni)\s*ne\s*baat\s*k[ai]",
    r"avara\s*(thamma|hendathi|appa|amma|anna|tangi|ganda|henthi)",
    r"office\s*inda",
    r"(wife|husband|father|mother|brother|sister|son|daughter)\s*(ne\s*)?(uthaya|uthaye|answered|picked)",
    r"spouse\s*answered",
    r"colleague\s*answered",
    r"leave\s*pe(\s*hai)?",
    r"bahar\s*gaye(\s*hain)?",
    r"borrower\s*ghar\s*par\s*nahi",
    r"ghar\s*wale\s*ne\s*(uthaya|uthay|baat)",
    r"family\s*member.*(answered|picked| baat)",
    r"saheb\s*nahi\s*hain.*(beta|bhai|patni)",
)
WHO_IS_THIS_CUE = (
    r"kaun\s*bol\s*rah[ae]\s*(hai|he)",
    r"kon\s*bol\s*r[ae]h[ae]",
    r"kaun\s*hai",
    r"aap\s*kaun",
    r"who\s*is\s*this",
    r"who\s*is\s*speaking",
    r"kis\s*se\s*baat.*chahte",
)
NAME_MISMATCH_CUE = (
    r"naam\s*(galat|alag|sahi\s*nahi)",
    r"wrong\s*name",
    r"name\s*(mismatch|wrong|different)",
    r"is\s*naam\s*ka\s*koi\s*nahi",
    r"yeh\s*naam.*nahi\s*(hai|suna)",
)
LANGUAGE_MISMATCH_CUE = (
    r"hindi\s*nahi\s*(aati|samajh)",
    r"bhasha\s*(nahi\s*)?samajh",
    r"language\s*(problem|mismatch|issue|barrier)",
    r"english\s*me\s*(baat|bolo|boliye)",
    r"samajh\s*nahi\s*aa\s*rah[ai]",
)
#: Cues of what a voice bot heard.
TRANSCRIPT_CUES = {"who_is_this": WHO_IS_THIS_CUE, "name_mismatch": NAME_MISMATCH_CUE, "language_mismatch": LANGUAGE_MISMATCH_CUE}
CUES = {"switched_off": SWITCHED_OFF_CUE, "wrong_number": WRONG_NUMBER_CUE, "avoidance": AVOIDANCE_CUE, "third_party": THIRD_PARTY_CUE}

# Fixed values.
NUMBER_WORDS = {
    "ek": 1, "do": 2, "eradu": 2, "teen": 3, "tin": 3, "char": 4, "chaar": 4, "paanch": 5, "panch": 5, "che": 6, "chhah": 6, "chhe": 6,
    "saat": 7, "sath": 7, "aath": 8, "aanth": 8, "nau": 9, "nav": 9, "das": 10, "dus": 10, "gyarah": 11, "barah": 12,
}
MONTH_UNITS = ("mahine", "mahina", "mahinon", "maheene", "maihne", r"tingal\w*", "months?", "mnth")
YEAR_UNITS = ("saals?", "sal", "years?")


def any_of(patterns) -> str:
    """One case-insensitive expression that matches where any of ``patterns`` does."""
    return "(?i)(?:" + "|".join(patterns) + ")"
