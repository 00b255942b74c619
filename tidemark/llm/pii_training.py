"""Labelled remarks composed from a small grammar, to train the detector of personal information.

The clauses are built of word classes, common words of a public vocabulary and forms made by rule; the
names, towns and number formats are public ones. Nothing is read off the corpus that is searched.
"""

from __future__ import annotations

import random
from functools import lru_cache

from tidemark.llm.pii_words import CLASSES, DIGIT_WORDS, PLACE_ENDS, vocabulary, word_class

#: Labelled texts composed for training; a fixed bound, whatever the corpus.
TRAINING_TEXTS = 18000

GIVEN = (
    "aarav aditi ajay akash alka amina anand anil anita anjali arjun arun asha ashok bala bharat bhavna chandra chetan deepa devi dinesh divya farah farhan fatima ganesh gauri geeta gopal "
    "hari harish hema imtiaz indira irfan ishaan jagdish jaya jyoti kailash kamala kavita kiran krishna lakshman lalita latha madhu mahesh malini manju manoj mary meena mohan mukesh nadeem nagaraj "
    "narayan naveen neha nirmala om padma pankaj pooja prakash pratibha praveen radha rahul raj rajendra ramesh rani ravi rekha reena rohit sachin salim sandeep sanjay santosh sarita satish seema "
    "shabana shanti shekhar shilpa shyam sonia sudha sunil suresh sushma tara thomas uma usha vandana varun venkatesh vidya vijay vikas vinod yashoda yusuf zoya peter john david anthony sara lucy grace rose"
).split()
FAMILY = (
    "acharya agarwal ahmed ansari bhat bhatt bose chauhan chopra choudhary das desai deshmukh dsouza dutta fernandes gandhi ghosh gowda goyal gupta hegde hussain iyer jadhav jain jha joshi kapoor kaur "
    "khan kulkarni kumar mehta menon mishra mohammed mukherjee naidu nair nambiar pandey patel patil pawar pillai prasad qureshi raju rao rathod reddy roy saxena sen shah sharma shaikh shetty shinde singh sinha "
    "soni srinivasan subramaniam swamy thakur tiwari trivedi varma verma yadav george mathew philip wilson brown smith"
).split()
TOWNS = (
    "agra ajmer aligarh amravati bareilly belagavi bellary bengaluru bhilai bhopal bikaner chennai coimbatore cuttack delhi dharwad dhule erode gaya guntur gurgaon gwalior hassan hosur hubli hyderabad indore jaipur jalna jhansi "
    "kanpur karur kochi kolar kolhapur kota latur lucknow madurai mandya mangaluru meerut mumbai mysuru nagpur nashik nellore noida ongole panipat patna pune raichur ranchi rohtak salem sangli satara shimoga solapur surat thane tumkur udaipur ujjain vellore warangal"
).split()
BRANDS = "hdfc icici axis sbi canara bajaj mahindra kotak airtel jio vodafone tata maruti honda hero samsung nokia amazon flipkart".split()
STREET_HEADS = "gandhi nehru mg ring station temple church college market tank bank hospital airport patel shivaji ambedkar link linking residency brigade richmond park hill river garden palace fort bus".split()
BUILDING_HEADS = "sunrise sunshine green royal silver golden shanti sai krishna om lake sea ocean pearl palm orchid rose galaxy star vasant ganga yamuna lakshmi prestige brindavan".split()

_ON = "b bh ch d dh g gh h j k kh l m n p pr r s sh t th v y z".split()
_MID = "a e i o u aa ee ai".split()
_DEVA = "क ख ग च ज त द न प ब म र ल व श स ह".split()
_DEVA_V = ["ा", "ि", "ी", "ु", "े", "ो", ""]
_DIGIT_NAMES = {d: [w for w, v in DIGIT_WORDS.items() if v == d] for d in range(10)}


def made_word(r: random.Random, least: int = 2, most: int = 3) -> str:
    return "".join(r.choice(_ON) + r.choice(_MID) for _ in range(r.randint(least, most))) + r.choice(["", "", "l", "n", "r", "sh", "m", "d", "t", "k"])


@lru_cache(maxsize=1)
def common_words() -> tuple[str, ...]:
    """Common lower-case words of the public vocabulary, in order."""
    known = word_class()
    return tuple(sorted(w for w, x in vocabulary().items() if x > 1.5 and len(w) > 3 and w not in known))


def digits(r: random.Random, n: int, first: str = "0123456789") -> str:
    return r.choice(first) + "".join(r.choice("0123456789") for _ in range(n - 1))


def cased(r: random.Random, s: str, title: float = 0.8) -> str:
    return s.title() if r.random() < title else s


def person(r: random.Random) -> str:
    form = r.random()
    if form < 0.05:
        return " ".join("".join(r.choice(_DEVA) + r.choice(_DEVA_V) for _ in range(r.randint(2, 4))) for _ in range(r.randint(1, 2)))
    first = made_word(r) if r.random() < 0.35 else r.choice(GIVEN)
    last = made_word(r, 2, 4) if r.random() < 0.35 else r.choice(FAMILY)
    form = r.random()
    name = first if form < 0.33 else f"{first} {last}" if form < 0.7 else f"{first} {r.choice(GIVEN)} {last}" if form < 0.8 else f"{first[0]}. {last}" if form < 0.87 else f"{first[0]} {last}" if form < 0.9 else f"{first} {last[0]}" if form < 0.95 else f"{first[0]}.{last[0]}. {r.choice(FAMILY)}"
    return cased(r, name, 0.87)


def town(r: random.Random) -> str:
    t = r.random()
    return cased(r, r.choice(TOWNS) if t < 0.4 else made_word(r, 1, 2) + r.choice(PLACE_ENDS) if t < 0.8 else made_word(r, 2, 3))


def _street(r: random.Random) -> str:
    t = r.random()
    kinds = "street st road rd lane marg gali galli chowk nagar colony cross main layout circle avenue extension block phase path puram mohalla bazaar veedhi peth enclave salai".split()
    if t < 0.2:
        return f"{r.randint(1, 30)}{r.choice(['st', 'nd', 'rd', 'th'])} {cased(r, r.choice(['cross', 'main', 'phase', 'block', 'street', 'avenue']))}"
    if t < 0.3:
        return cased(r, r.choice(["sector", "ward", "phase", "block"])) + r.choice([" ", " no ", "-"]) + str(r.randint(1, 90))
    head = r.choice(STREET_HEADS) if t < 0.55 else r.choice(FAMILY + GIVEN) if t < 0.7 else made_word(r) if t < 0.9 else r.choice(common_words()) + " " + r.choice(STREET_HEADS)
    return cased(r, f"{head} {r.choice(kinds)}")


def address(r: random.Random) -> str:
    n, t = r.randint(1, 999), r.random()
    num = str(n) if t < 0.4 else f"{n}/{r.randint(1, 40)}" if t < 0.55 else f"{n}-{r.randint(1, 99)}/{r.randint(1, 9)}" if t < 0.65 else f"{n}{r.choice('ABCD')}" if t < 0.75 else f"{r.randint(1, 99)}-{r.choice('ABCDEF')}" if t < 0.85 else f"{r.choice('ABCDEF')}{r.choice(['-', '/', ' '])}{r.randint(1, 40)}" if t < 0.95 else f"{r.choice('ABC')}{n}"
    lead = "" if r.random() < 0.2 else r.choice(["", "#", "# ", "flat ", "flat no ", "flat no. ", "plot ", "plot no ", "house ", "house no ", "house no. ", "h no ", "h.no ", "h. no. ", "door no ", "d.no ", "makaan ", "makaan no ", "quarter no ", "qtr ", "room no ", "shop no ", "villa ", "no. ", "no "])
    if t >= 0.85 and not lead:
        lead = "flat "
    parts = [cased(r, lead, 0.5).rstrip() + (" " if lead.endswith(" ") else "") + num]
    if r.random() < 0.25:
        parts.append(r.choice([f"{r.randint(1, 20)}{r.choice(['st', 'nd', 'rd', 'th'])} floor", f"{r.choice('abcd')} wing", f"block {r.choice('ABC')}", f"tower {r.randint(1, 9)}"]))
    if r.random() < 0.3:
        parts.append(cased(r, f"{r.choice(BUILDING_HEADS) if r.random() < 0.6 else made_word(r)} {r.choice('apartments towers residency heights complex bhavan niwas chs society building chambers'.split())}"))
    if r.random() < 0.9 or len(parts) == 1:
        parts.append(_street(r))
    if r.random() < 0.2:
        parts.append(f"{r.choice(['near', 'opp', 'behind', 'beside', 'next to'])} {cased(r, r.choice(STREET_HEADS) + ' ' + r.choice('temple school mill tank stand gate well'.split()))}")
    if r.random() < 0.2:
        parts.append(_street(r))
    if r.random() < 0.65:
        parts.append(town(r))
    out = parts[0] + r.choice([", ", " "]) + r.choice([", ", ", ", " "]).join(parts[1:])
    return out + (r.choice([" ", ", ", " - ", "-"]) + digits(r, 6, "12345678") if r.random() < 0.3 else "")


def email(r: random.Random) -> str:
    a, b = (r.choice(GIVEN) if r.random() < 0.6 else made_word(r)), (r.choice(FAMILY) if r.random() < 0.6 else made_word(r))
    user = r.choice([f"{a}.{b}", f"{a}{r.randint(1, 9999)}", f"{a}_{b}{r.randint(1, 99)}", f"{a[0]}{b}", f"{a}-{b}", f"{b}+{made_word(r)}", f"{a}{b}"])
    host = r.choice(["gmail", "yahoo", "hotmail", "outlook", "rediffmail", made_word(r), made_word(r), f"{made_word(r)}-{made_word(r)}", f"mail.{made_word(r)}"])
    top = r.choice(["com", "com", "in", "co.in", "org", "net", "net.in", "edu", "test", "example", "invalid"])
    t = r.random()
    if t < 0.7:
        out = f"{user}@{host}.{top}"
    elif t < 0.78:
        out = f"{user} @ {host}.{top}"
    elif t < 0.88:
        out = f"{user}{r.choice(['(at)', '[at]', ' (at) ', ' [at] '])}{host}.{top}"
    else:
        out = f"{user} at {host} dot {top.replace('.', ' dot ')}"
    return out.upper() if r.random() < 0.05 else out


def phone(r: random.Random) -> str:
    d = digits(r, 10, "6789" if r.random() < 0.8 else "23456789")
    t = r.random()
    if t < 0.08:
        words, i = [], 0
        while i < len(d):
            n = 1
            while n < 3 and i + n < len(d) and d[i + n] == d[i]:
                n += 1
            word = r.choice(_DIGIT_NAMES[int(d[i])])
            if n > 1 and r.random() < 0.6:
                words.append(f"{'double' if n == 2 else 'triple'} {word}")
                i += n
            else:
                words.append(word)
                i += 1
        return r.choice([" ", " ", ", ", "-"]).join(words)
    if t < 0.16:
        return d.translate(str.maketrans("0123456789", r.choice(["०१२३४५६७८९", "೦೧೨೩೪೫೬೭೮೯"])))
    area = r.choice(["022", "011", "080", "044", "040", "033", "020", "0265", "0821", "08192"])
    forms = [d, d, d, "0" + d, "+91" + d, f"+91-{d}", f"+91 {d[:5]} {d[5:]}", f"91 {d}", f"91{d}", f"{d[:5]} {d[5:]}", f"{d[:5]}-{d[5:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:4]} {d[4:7]} {d[7:]}", f"({d[:3]}) {d[3:6]} {d[6:]}", f"({d[:4]}) {d[4:7]} {d[7:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"{d[:4]}.{d[4:7]}.{d[7:]}", f"{area}-{digits(r, 11 - len(area), '2345678')}", f"({area}) {digits(r, 11 - len(area), '2345678')}", f"({area}) {digits(r, 3)} {digits(r, 8 - len(area))}", f"{area} {digits(r, 11 - len(area), '2345678')}"]
    return r.choice(forms)


def identity(r: random.Random) -> tuple[str, str]:
    """The words before an identity number, and the number."""
    up = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    d, kind = digits(r, 12), r.randint(0, 4)
    link = lambda *names: r.choice(names) + r.choice([" ", " ", " no ", " no. ", " number ", " is ", ": ", " card "])
    if kind == 0:
        body = r.choice([d, f"{d[:4]} {d[4:8]} {d[8:]}", f"{d[:4]}-{d[4:8]}-{d[8:]}"])
        lead = link("aadhaar", "aadhar", "adhar", "uid", "Aadhaar", "AADHAAR", "UID") if body == d or r.random() < 0.7 else ""
    elif kind == 1:
        p = f"{up(3)}{r.choice('PCHFATBLJG')}{up(1)}{digits(r, 4)}{up(1)}"
        body = r.choice([p, p, p.lower(), f"{p[:5]} {p[5:9]} {p[9:]}", f"{p[:5]}-{p[5:9]}-{p[9:]}"])
        lead = link("pan", "PAN", "Pan") if r.random() < 0.75 else ""
    elif kind == 2:
        body, lead = up(1) + r.choice(["", " "]) + digits(r, 7), link("passport", "Passport") if r.random() < 0.9 else ""
    elif kind == 3:
        body, lead = up(3) + r.choice(["", " "]) + digits(r, 7), link("voter id", "voter", "epic", "EPIC", "Voter ID") if r.random() < 0.85 else ""
    else:
        s, rto, year, tail = r.choice("KA MH TN DL UP RJ GJ AP TS WB KL HR".split()), digits(r, 2), str(r.randint(1985, 2025)), digits(r, 7)
        body = r.choice([f"{s}{rto}{year}{tail}", f"{s}-{rto} {year} {tail}", f"{s}{rto} {year}{tail}", f"{s}-{rto}-{year}-{tail}", f"{s} {rto} {year} {tail}"])
        lead = link("dl", "DL", "driving licence", "licence", "driving license") if r.random() < 0.85 else ""
    return lead, body


# Clauses -------------------------------------------------------------------------------------


def _of(r: random.Random, name: str) -> str:
    return r.choice(CLASSES[name].split())


def _who(r: random.Random) -> str:
    t = r.random()
    kin = _of(r, "kin")
    if t < 0.4:
        return r.choice(["customer", "borrower", "applicant", "he", "she", "his", "client", "tenant", "neighbour", "guard", "owner", "watchman", "agent", "officer"]) if t < 0.33 else f"{_of(r, 'pron')} {kin}"
    return kin if t < 0.65 else _of(r, "role") if t < 0.9 else f"{cased(r, r.choice(common_words()), 0.3)} {_of(r, 'role')}"


_VERBS = "said told agreed asked refused promised wants wanted requested denied confirmed informed called came went paid left answered ignored disconnected accepted disputed complained explained visited waited shouted apologised".split()


def _thing(r: random.Random) -> str:
    words = common_words()
    return r.choice([r.choice(words), f"{r.choice(words)} {r.choice(words)}", _of(r, "product"), f"the {r.choice(words)}", f"{_of(r, 'product')} {r.choice(words)}", f"{_of(r, 'time')} {r.choice(words)}"])


def _number_clause(r: random.Random) -> str:
    """A number that is no personal information, with words that say so."""
    lead = r.choice(["utr", "UTR", "txn", "transaction id", "ref no", "reference number", "receipt", "loan a/c", "loan account", "loan no", "LAN", "case", "case no", "ticket", "complaint no", "order id", "order", "invoice", "batch", "cheque no", "chq", "mandate", "policy no", "agreement no", "account no", "a/c no", "acct", "challan", "awb", "docket", "approval code", "imei", "bill no", "token", "employee id", "vehicle", "file no", "memo"])
    n = r.choice([6, 8, 9, 10, 10, 10, 11, 12, 12, 12, 14, 16])
    body = r.choice(["", "", "", "#", "LN", "TX", "CS-", "REF", "INV", "AC", "TKT-"]) + digits(r, n, "123456789")
    tail = r.choice(["", " shared", " generated", " raised", " failed", " cleared", " pending", " bounced", " noted", " closed", f" {r.choice(common_words())}"])
    return f"{lead}{r.choice([' ', ' ', ': ', ' is '])}{body}{tail}"


def _amounts(r: random.Random) -> str:
    n = r.randint(100, 999999)
    amount = r.choice([f"{n}", f"{n:,}", f"Rs {n}", f"Rs.{n}", f"{n}/-", f"INR {n:,}", f"{n}.00", f"{r.randint(1, 90)}k"])
    day = r.choice([f"{r.randint(1, 28)}/{r.randint(1, 12)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/20{r.randint(20, 27)}", f"{r.randint(1, 28)}-{r.randint(1, 12)}-20{r.randint(20, 27)}", f"{r.randint(1, 28)}th {_of(r, 'time')}", f"20{r.randint(20, 27)}-0{r.randint(1, 9)}-{r.randint(10, 28)}"])
    clock = f"{r.randint(8, 20)}:{r.choice(['00', '15', '30', '45'])}"
    return r.choice([f"{_who(r)} paid {amount} on {day}", f"emi {amount} due {day}", f"ptp {day} {amount}", f"balance {amount}", f"will pay {amount} by {day}", f"call after {clock}", f"between {clock} and {clock}", f"{r.randint(2, 90)} days past due", f"visit on {day} at {clock}", f"discount of {r.randint(5, 60)}%", f"{r.randint(2, 20)} {r.choice(['missed calls', 'attempts', 'emis', 'months'])}", f"gps {r.randint(8, 30)}.{digits(r, 4)}, {r.randint(70, 88)}.{digits(r, 4)}", f"pin {digits(r, 6, '12345678')}", f"account {digits(r, 10, '123456789')} and {digits(r, 10, '123456789')}", f"loan {digits(r, 10, '123456789')} {r.choice(common_words())} {r.choice(['with', 'into', 'and', 'to'])} {digits(r, 10, '123456789')}", f"otp {digits(r, 6)}", f"https://{made_word(r)}.com/{digits(r, 6)}", f"{r.randint(1, 200)} {r.choice(common_words())} {r.choice(common_words())}"])


def neutral(r: random.Random) -> str:
    t, words, known = r.random(), common_words(), word_class()
    if t < 0.2:
        return f"{_who(r)} {r.choice(_VERBS)} {r.choice(['', 'to ', 'for ', 'that '])}{_thing(r)}"
    if t < 0.28:
        return f"{r.choice(_VERBS)} {r.choice(['with', 'to', 'by', 'from', 'at'])} {_who(r)}"
    if t < 0.32:
        return " ".join(r.choice([r.choice(_forms()), _of(r, "func"), _of(r, "post"), made_word(r, 1, 2), _of(r, "pron"), r.choice(words)]) for _ in range(r.randint(3, 7)))
    if t < 0.42:
        forms = [w for w in _forms()]
        lead = r.choice(["", f"{_who(r)} {r.choice(['ne', 'ko', 'se', 'ka', 'ke', 'ki'])} ", f"{_of(r, 'pron')} "])
        return lead + " ".join([r.choice([_of(r, "func"), r.choice(words), _of(r, "post"), r.choice(["kal", "ghar", "paisa", "samay", "kaam", "dukaan", "bahar", "andar"])]) for _ in range(r.randint(0, 2))] + [r.choice(forms) for _ in range(r.randint(1, 2))] + ([_of(r, "func")] if r.random() < 0.4 else []))
    if t < 0.5:
        return " ".join(r.choice([r.choice(words), _of(r, "func"), _of(r, "prep"), _of(r, "role"), _of(r, "product")]) for _ in range(r.randint(2, 6)))
    if t < 0.56:
        return f"{r.choice(['met', 'called', 'spoke to', 'spoke with', 'visited', 'contacted', 'this is', 'call from', 'met with', 'informed'])} {cased(r, _of(r, 'role') + ' ' + _of(r, 'role'), 0.5)}"
    if t < 0.62:
        firm = cased(r, f"{r.choice([made_word(r), r.choice(BUILDING_HEADS), r.choice(GIVEN), r.choice(FAMILY), r.choice(words), r.choice(BRANDS)])} {_of(r, 'firm')}", 0.85) + (" " + cased(r, _of(r, "firm")) if r.random() < 0.2 else "")
        return f"{r.choice(['works at', 'employed with', 'spoke to', 'called', 'office is', 'owner of', 'call from', 'this is', 'runs', 'near', 'met staff of', 'salary from', 'answered by', '', _of(r, 'kin'), _of(r, 'role'), r.choice(_VERBS), r.choice(words)])} {firm} {r.choice(['', '', 'answered', 'confirmed', 'closed', 'ne bola'])}".strip()
    if t < 0.65:
        return f"{r.choice(['', _who(r) + ' '])}{r.choice([r.choice(_VERBS), r.choice(words), ''])} {r.choice(['at', 'near', 'from', 'of', ''])} {r.choice([r.choice(words), r.choice(STREET_HEADS), _of(r, 'firm'), 'shop', 'market'])} {r.choice(['in', 'in', 'at', 'near', 'of', 'outside'])} {town(r)}".replace("  ", " ").strip()
    if t < 0.7:
        return f"{r.choice(['', _who(r) + ' '])}{r.choice(['shifted to', 'moved to', 'gone to', 'went to', 'native of', 'native place', 'works in', 'posted at', 'transferred to', 'lives in', 'staying at', 'visited', 'branch at', 'travelling to', 'resides in', 'from', 'relocated to', 'now in', 'presently at'])} {town(r)}{r.choice(['', '', ' for work', ' branch', ' area', ' last ' + _of(r, 'time')])}"
    if t < 0.74:
        return f"{town(r)} {r.choice(['me rehta hai', 'gaya hai', 'shift ho gaya', 'me hai', 'me kaam karta hai', 'se hai', 'branch', 'alli idare', 'chala gaya', 'office'])}"
    if t < 0.82:
        return _number_clause(r)
    if t < 0.93:
        return _amounts(r)
    if t < 0.97:
        what = r.choice(["phone", "mobile", "number", "email", "mail id", "address", "name", "aadhaar", "pan", "passport", "alternate number", "kyc", "id proof", "ghar ka pata", "naam"])
        return f"{what} {r.choice(['not given', 'not available', 'nahi diya', 'pending', 'mismatch', 'wrong', 'switched off', 'not reachable', 'refused', 'asked for', 'not shared', 'to be updated', 'invalid', 'galat hai', 'change ho gaya'])}"
    return r.choice([f"{r.choice(BRANDS).title()} {made_word(r).title()} {r.choice(words)}", f"{r.choice(words).title()} {r.choice(words).title()} {r.choice(words)}", f"{r.choice(['festival of', 'after', 'before', 'during', 'on'])} {made_word(r).title()}", f"{cased(r, _of(r, 'product') + ' ' + _of(r, 'product'), 0.7)} {r.choice(words)}", f"{cased(r, r.choice(BRANDS))} {r.choice(words)}", f"{cased(r, _of(r, 'time'))} {r.choice(words)}", f"needs {r.choice(['Tamil', 'Telugu', 'Marathi', 'Bengali', 'English', 'Hindi', 'Urdu', 'Kannada'])} speaking {_of(r, 'role')}"]) if known else ""


@lru_cache(maxsize=1)
def _forms() -> tuple[str, ...]:
    return tuple(sorted(w for w, c in word_class().items() if c == "hinglish"))


NAME_BEFORE = "spoke to|spoke with|spoken to|talked to|met|met with|met mr|this is|his name is|her name is|name:|name is|naam|naam hai|contact person|contact|ask for|asked for|attended by|answered by|picked by|picked up by|call from|call|called|informed|told|given by|paid by|received by|signed by|handed over to|as per|according to|guarantor|co-applicant|nominee|reference|his wife|his brother|her husband|father|son of|s/o|d/o|w/o|c/o|neighbour|agent|Mr|Mrs|Ms|Mr.|Mrs.|Smt|Smt.|Shri|Sri|Dr|Dr.|miss|customer|borrower|tenant|owner|brother|with|to|by|from|visited|meet|thanks to|referred by".split("|")
NAME_AFTER = "answered|picked|picked up the call|said he will pay|said|told|confirmed|confirms|refused|promised|is not at home|is the tenant|is abroad|has shifted|will call back|came to branch|paid|called back|ji|ji se baat|ji ne kaha|ne bola|ne kaha|ne bataya|ne uthaya|ne phone kiya|ko bataya|ko bola|se baat ki|se mila|ka phone|ka number|ke ghar|ki wife|bol raha|bol rahi|nahi hai|expired|at shop|at home|at office|is wife|his son|helidru|idare|avara mane|requests time|wants settlement|disputes|left the job|denied|met us|agreed|lives here|works here|has gone out|next door|over phone".split("|")
ADDRESS_BEFORE = "new address|address|address is|lives at|living at|stays at|staying at|residing at|resides at|shifted to|moved to|current address|permanent address|office at|shop at|house is|visited|visit|met at|found at|traced to|pata|pata hai|naya pata|ghar|relocated to|located at|send notice to|notice sent to|residence|add:|addr|now at|from|at|to".split("|")
ADDRESS_AFTER = "|||is locked|visited|found locked|me rehta hai|par rehte hain|pe mila|confirmed|is rented|not traceable|se shift|is wrong|alli idare|vacated".split("|")
EMAIL_BEFORE = "email|email id|e-mail|mail|mail id|mail to|email is|mail id is|send to|send statement to|sent to|write to|wrote to|cc|contact at|forward to|id|reach at|bhejo|share on|noc to|new email|copy to|registered email|".split("|")
EMAIL_AFTER = "|||is correct|is his id|pe bhejo|par bhej do|bounced|noted|updated|is not valid|for statement|diya|for noc".split("|")
PHONE_BEFORE = "mobile|mobile is|his mobile is|her number|number|new number|alternate number|alternate no|phone|phone no|ph|ph:|contact no|contact number|landline|office number|whatsapp|whatsapp no|call|call on|call him on|call back on|dial|reach on|reachable on|try|wife's number|brother number|given number|mob|mob no|cell|tel|new sim|sms to|naya number|dusra number|is number pe|ghar ka number|no|no.|number is|text|ring on|ring|updated contact|".split("|")
PHONE_AFTER = "|||switched off|not reachable|is wrong|pe call karo|par baat karo|is his wife's|of brother|answered|noted|ka hai|for contact|whatsapp|after 6|is new number|not in use|belongs to neighbour|se call aaya|given by wife".split("|")
ID_AFTER = "|||verified|seen|collected|copy taken|submitted|attached|mismatch|expired|uploaded|checked|provided|dikhaya|liya|for kyc|updated".split("|")
ID_BEFORE = "|||customer gave|copy of|his|her|collected|verified|shared|document|submitted|kyc|photo of|showed|checked|has|new|uploaded".split("|")


_AUX = "is was will has had would can could did also just never then".split()
_DOING = "ing ed".split()


def _name_clause(r: random.Random, name: str) -> tuple[str, str, str]:
    """A name as subject or object among words of no particular sign."""
    words, t = common_words(), r.random()
    some = lambda: r.choice([r.choice(words), f"{r.choice(words)} {r.choice(words)}", _thing(r), f"the {r.choice(words)}", f"{_of(r, 'prep')} {r.choice(words)}", f"{_of(r, 'prep')} the {r.choice(words)}", f"{_of(r, 'time')}", f"{_of(r, 'func')} {r.choice(words)}"])
    if t < 0.35:
        return (f"{r.choice(['', '', 'and ', 'that ', 'says ', 'where ', _who(r) + ' '])}", name, f" {r.choice([r.choice(_AUX) + ' ' + r.choice(words), r.choice(_VERBS), r.choice(words) + r.choice(_DOING), r.choice(words)])} {some()}")
    if t < 0.8:
        return (f"{r.choice(['', _who(r) + ' ', _of(r, 'pron') + ' '])}{r.choice([r.choice(_VERBS), r.choice(words), r.choice(_AUX) + ' ' + r.choice(words)])} {r.choice(['to', 'by', 'with', 'from', 'for', 'via', 'through', 'and', 'only', 'that', ''])} ".replace("  ", " "), name, f" {some()}" if r.random() < 0.6 else "")
    if t < 0.9:
        return (f"{r.choice(['', some() + ' '])}{_of(r, 'kin') if r.random() < 0.6 else _of(r, 'role')} ", name, f" {some()}")
    return "", name, r.choice([", ", " (", ": ", " - "]) + r.choice([_of(r, "kin"), _of(r, "role"), some()])


def _wrap(r: random.Random, before: list[str], after: list[str], body: str, both: float = 0.3) -> tuple[str, str, str]:
    t = r.random()
    b, a = r.choice(before), r.choice(after)
    if r.random() < 0.3:
        b = f"{r.choice(['', _who(r) + ' '])}{r.choice([r.choice(_VERBS), r.choice(common_words())])}{r.choice(['', '', ' ' + _of(r, 'prep')])}"
    if r.random() < 0.2:
        a = f"{_of(r, r.choice(['func', 'prep', 'pron', 'comm', 'time']))} {r.choice(common_words())}"
    if t < 1 - both:
        b, a = (b, "") if r.random() < 0.6 else ("", a)
    if b and r.random() < 0.15:
        b = r.choice([_who(r), "and", "also", r.choice(common_words())]) + " " + b
    return (b + (" " if b and not b.endswith(("-",)) else "")), body, (" " + a if a else "")


def training_texts(n: int = TRAINING_TEXTS, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Composed remarks with the spans of the personal information in them."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, true = "", []
        for k in range(r.choice([1, 1, 2, 2, 3, 4])):
            if k:
                text += r.choice([" / ", ". ", ", ", "; ", " - ", "\n", " ", ". ", " and ", " | "])
            pick = r.random()
            kind = ""
            if pick < 0.2:
                kind, (head, body, tail) = "name", _name_clause(r, person(r)) if r.random() < 0.45 else _wrap(r, NAME_BEFORE, NAME_AFTER, person(r))
                if not (head or tail):
                    tail = " " + r.choice(NAME_AFTER)
            elif pick < 0.32:
                kind, (head, body, tail) = "address", _wrap(r, ADDRESS_BEFORE, ADDRESS_AFTER, address(r), 0.2)
            elif pick < 0.39:
                kind, (head, body, tail) = "email", _wrap(r, EMAIL_BEFORE, EMAIL_AFTER, email(r))
            elif pick < 0.52:
                kind, (head, body, tail) = "phone", _wrap(r, PHONE_BEFORE, PHONE_AFTER, phone(r))
            elif pick < 0.63:
                kind = "id_number"
                lead, number = identity(r)
                head, body, tail = _wrap(r, ID_BEFORE, ID_AFTER, number)
                head += lead
            else:
                head, body, tail = neutral(r), "", ""
            if r.random() < 0.35 and head and head[0].isalpha():
                head = head[0].upper() + head[1:]
            at = len(text) + len(head)
            text += head + body + tail
            if kind:
                true.append((at, at + len(body), kind))
        t = r.random()
        if t < 0.12 and len(text.upper()) == len(text):
            text = text.upper()
        elif t < 0.28 and len(text.lower()) == len(text):
            text = text.lower()
        out.append((text, true))
    return out
