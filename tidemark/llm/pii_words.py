"""Classes of words for the search of personal information, from general knowledge and public vocabularies.

Nothing here is read off the corpus: closed classes are listed, romanised Hindi and Kannada forms are
made of stems and endings, and how common a word is as a word or as a proper noun comes from the ranks
of a public byte-level vocabulary.
"""

from __future__ import annotations

import math
from functools import lru_cache

from tidemark.llm.tokenize import read_ranks, vocabulary_path

DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "shunya": 0, "ek": 1, "do": 2, "teen": 3, "char": 4, "paanch": 5, "chhe": 6, "chhah": 6, "saat": 7, "aath": 8, "nau": 9,
}
REPEATS = ("double", "triple")

CLASSES: dict[str, str] = {
    "honorific": "mr mrs ms miss dr smt smti shri sri shrimati kumari km sir madam mister prof adv late m/s",
    "role": "manager supervisor officer agent executive telecaller caller collector watchman guard security lender bank banker branch customer borrower coborrower owner tenant landlord landlady neighbour neighbor party driver receptionist staff team desk department head office clerk cashier advocate lawyer police constable colleague boss employer employee worker maid cook guarantor applicant nominee sarpanch dealer vendor client person someone nobody everyone lady gentleman boy girl man woman child kid family member relative friend roommate visitor stranger",
    "kin": "wife husband brother sister father mother son daughter uncle aunt aunty cousin nephew niece spouse grandfather grandmother inlaw bhai bhaiya behen bahen didi patni pati pita papa mata mummy maa beta beti chacha chachi mama mami nana nani dada dadi bhabhi jija saali sasur saas thamma tangi anna akka appa amma hendathi ganda maga magalu padosi dost rishtedar",
    "firm": "ltd limited pvt llp inc corp company co firm enterprises traders trading industries stores store mart shop medicals pharmacy clinic hospital hotel restaurant dhaba bakery jewellers textiles garments fabrics tailors motors automobiles garage travels transport logistics electronics electricals hardware finance fincorp capital bank services solutions consultants agency agencies associates school college academy institute salon parlour studio press printers foundation trust cooperative society telecom",
    "product": "gold loan home car two wheeler vehicle personal business credit debit card upi emi nach ecs kyc otp pan aadhaar noc cibil sms app gst atm ivr dpd npa top up insurance policy scheme mandate statement moratorium settlement paytm phonepe gpay whatsapp google",
    "street": "street st road rd lane ln marg gali galli chowk nagar colony cross main layout circle avenue ave extension extn block phase path puram mohalla sector ward area stage highway bypass bazar bazaar peth veedhi veedi salai theru puri vihar enclave garden gardens park market mandi tola para chawl basti gaon taluk tehsil",
    "building": "apartment apartments apts tower towers residency heights villa villas complex bhavan bhawan niwas nivas sadan chs society flats plaza mansion manor court palace building bldg chambers arcade kutir kunj house floor wing",
    "house": "flat plot house hno door dno makaan makan quarter quarters qtr room shop unit villa bungalow survey khasra gharkul no number num",
    "relative_place": "near opp opposite behind beside next above below adjacent front backside paas peeche saamne bagal upar neeche",
    "comm": "spoke spoken speak talked talk told tell informed inform met meet meets asked ask answered answers answer picked picks attended confirmed confirms confirm said says saying stated states replied replies called calls contacted explained requested promised refused denied assured introduced responded received cooperated shouted abused baat bola bole boli kaha kahi bataya batayi uthaya uthayi mila mili mile milaa",
    "motion": "shifted shift moved move moving relocated relocate gone went go goes going came come comes transferred posted travelled traveled left leaves reached lives live living lived stays stay staying stayed resides residing works work working worked employed native born visit visited visits visiting found traced settled rehta rehti rehte gaya gayi gaye",
    "naming": "name named names naam nam hesaru called alias titled",
    "prep": "to with by from of at in on for about into through via against under over inside outside towards",
    "post": "ko ne se ka ki ke me mein pe par tak ji saab sahab saheb bhi hi wala wali",
    "phoneword": "phone mobile mob cell cellphone telephone tel ph landline contact whatsapp number no num nos line alternate alternative sim call callback dial ring reachable handset extension",
    "idword": "aadhaar aadhar adhar adhaar uid uidai pan passport voter epic licence license dl driving dlno ration identity id identification document",
    "refword": "utr txn transaction ref reference receipt loan lan account acct ac a/c case ticket complaint order invoice batch cheque chq check mandate pin pincode zip amount amt rs inr rupees emi balance outstanding bill challan docket agreement policy employee agent customer file memo token request sr version build room serial registration vehicle imei code approval auth booking consignment awb scheme",
    "mailword": "mail email e-mail gmail inbox mailid mailed emailed write send sent cc forward",
    "addrword": "address addr pata residence permanent current resident house home location place premises site",
    "pron": "he she it they i we you his her their him them my our your its this that these those who whom someone same other another wo woh yeh ye usne unhone maine hum aap uska uski unka unki mera meri avaru avara naanu neevu",
    "func": "the a an and or but if is was are were be been being has have had will would can could should may might must not no yes nor so as than then there here when where why how which what while until till since before after again also only just now today tomorrow yesterday soon later still yet already very too more most some any all both each every do does did done am pm ok okay please pls plz kindly hai hain tha thi the ho hua hui hue nahi nahin na mat haan aur ya lekin magar par phir abhi baad pehle aaj kal parso jab tab agar toh to kya kyun kab kahan kaun koi kuch sab bahut thoda illa ide idare alli beku beda matte",
    "language": "hindi kannada tamil telugu malayalam marathi bengali bangla gujarati punjabi urdu odia english assamese konkani tulu",
    "time": "monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun january february march april may june july august september october november december jan feb mar apr jun jul aug sept oct nov dec morning evening afternoon noon night week month year day days weeks months diwali holi eid christmas pongal ugadi dussehra subah shaam raat dopahar mahina mahine hafta hafte saal tarikh",
}

_HINDI = "kar kaat daal maar dal de le bol bata aa ja mil rah uth rakh bhej chal dekh sun samajh pooch mang lag kat khol ruk chhod pakad nikal baith soch likh bech kharid bhar chuka jama pahunch laut badal jud ban maan dhundh tod".split()
_HINDI_ENDS = ["", *"na ne ni ta ti te a i e o ke kar unga ungi enge ega egi aya ayi aye rahe raha rahi iye wana wa diya diye di liya liye gaya gayi denge dega dunga dungi".split()]
_KANNADA = "matad maatad mathad kaan oppik keli keld nadi oduh malag maad hel bar hog kod tog sig nod kel iru kar tand bit kall odd madk mad kodt helt bard".split()
_KANNADA_ENDS = ["", *"i u a e idru idre idare tini tare tiru idaru beku bahudu otta utte ilva illa okke alla tha tharu idini dru".split()]
#: Other everyday words of romanised Hindi and Kannada.
_PLAIN = (
    "paisa paise rupaya rupaye ghar makan kaam dukaan dukan gaadi gadi kharcha byaj kist kisht udhar karz karza naukri tankha vetan bimar bimari dawai aspatal gaon sheher bahar andar samay waqt mausam barish fasal kheti "
    "shaadi bachcha bachche bacche ladka ladki aadmi aurat log bada bade chhota chhote accha acha bura galat sahi theek thik pura poora aadha adha jyada zyada kam thoda bahut gussa gusse naraz khush pareshan pareshani majboor majboori "
    "zaroor zarur jaldi der dheere turant roz hamesha kabhi shayad bilkul sirf bas khaali khali band chalu chaalu khula bandh taala tala darwaza gate khabar baat cheez kuch intezaar intezar koshish madad maaf maafi shikayat faisla jawab sawal "
    "mushkil aasan problem dhanda vyapar mazdoor mazduri kisan zameen paani bijli rasta gali samaan saaman chabi kagaz kagaj dastavej beech hisaab hisab raqam rakam byaaj bhugtan jama nikala dobara pichla pichle agla agle dusra dusre teesra doosre naya nayi purana "
    "dunga dungi denge dega degi lunga lungi lenge lega legi jaunga jaungi jayenge jayega jayegi aaunga aaungi aayenge aayega aayegi hoga hogi honge karwa rakha rakhi liya diya kiya kari kiye pada padega chahiye sakta sakti sakte "
    "mane duddu hana salary kelasa ooru naale nale ivattu ninne mundina hinde mele kelage tumba swalpa gottu gottilla bandilla banda hogi hogiddare togolli madalla aagalla aaytu sari thappu hosa hale dodda chikka yaru yaake yavaga elli hege estu eega aamele"
).split()
#: Endings of place names, for the feature that tells towns from people.
PLACE_ENDS = "pur pura puram pet peth bad abad nagar garh gadh palli halli uru ooru wadi vadi gaon gram ganj patnam patna giri kot guda khera kheda nur mau kulam cheri kode palayam valasa town ville ton land gund katte".split()


@lru_cache(maxsize=1)
def word_class() -> dict[str, str]:
    out: dict[str, str] = {}
    for s in _HINDI:
        for e in _HINDI_ENDS:
            out.setdefault(s + e, "hinglish")
    for s in _KANNADA:
        for e in _KANNADA_ENDS:
            out.setdefault(s + e, "hinglish")
    for w in _PLAIN:
        out.setdefault(w, "hinglish")
    for name in reversed(CLASSES):
        for w in CLASSES[name].split():
            out[w] = name
    for w in (*DIGIT_WORDS, *REPEATS):
        out.setdefault(w, "digitword")
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> dict[str, float]:
    """For each word of a public byte-level vocabulary the log of its rank in title case over its
    rank in lower case: far below 0 for proper nouns, far above for common words."""
    low: dict[str, int] = {}
    title: dict[str, int] = {}
    ranks = read_ranks(path or vocabulary_path())
    for rank, token in enumerate(ranks):
        text = token.decode("utf-8", "ignore")
        if len(text) > 2 and text[0] == " " and text[1:].isalpha():
            if text[1:].islower():
                low[text[1:]] = rank
            elif text[1:].istitle():
                title[text[1:].lower()] = rank
    worst = float(len(ranks) * 2)
    return {w: math.log((title.get(w, worst) + 100) / (low.get(w, worst) + 100)) for w in {*low, *title}}


def is_common(word: str, words: dict[str, float]) -> bool:
    """A listed or a common word in lower case, or a regular form of one."""
    if word in word_class() or words.get(word, -9.0) > -0.7:
        return True
    for end, put in (("ies", "y"), ("ied", "y"), ("es", ""), ("s", ""), ("ed", ""), ("ed", "e"), ("ing", ""), ("ing", "e"), ("ly", ""), ("er", ""), ("ers", ""), ("ment", "")):
        if word.endswith(end) and len(word) > len(end) + 2 and words.get(word[: -len(end)] + put, -9.0) > 0.7:
            return True
    return any(word.startswith(pre) and words.get(word[len(pre) :], -9.0) > 0.7 for pre in ("in", "un", "re", "dis", "mis", "non", "over", "under", "out", "pre") if len(word) > len(pre) + 3)
