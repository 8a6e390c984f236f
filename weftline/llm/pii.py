"""Personal information inside free text.

A conditional random field over word shapes labels the tokens of a message; it is trained from a small labelled
table that this module spells out of carrier sentences. Spans found are checked by form and replaced by placeholders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.crf import Chain

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: Words on this share of all messages or more are known to be no names; that bounds their number.
COMMON_SHARE = 0.001
EXAMPLES = 6000

_CJK = "぀-ヿ一-鿿"
TOKEN = re.compile(rf"[{_CJK}]+|" r"https?://\S+|www\.\S+|[^\s@<>()\[\],;:\"]+@[^\s@<>()\[\],;:\"]*[^\W_]|" rf"(?:(?![{_CJK}])[^\W_])+(?:['’](?:(?![{_CJK}])[^\W_])+)*|[^\w\s]|_")
#: The digits spelled out.
_NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_SPELLED = re.compile(r"\b(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)\b", re.I)
_DIGITS = "०१२३४५६७८९"


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def _shape(token: str) -> str:
    out = []
    for c in token:
        s = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != s or not s.isalnum():
            out.append(s)
    return "".join(out)


def _features(token: str, common: frozenset[str]) -> list[str]:
    """Features of a token on its own."""
    low = token.lower()
    digits = sum(c.isdigit() for c in token)
    out = ["b", "s" + _shape(token)]
    if "@" in token and len(token) > 1:
        return [*out, "mail", "m" + ("." if "." in token.rsplit("@", 1)[1] else "-")]
    if low.startswith(("http", "www.")):
        return [*out, "url"]
    if digits:
        out += [f"d{min(digits, 14)}", f"l{min(len(token), 15)}", "w" + re.sub(r"\d", "9", low)[:12]]
        if digits != len(token):
            out.append("mix")
        if token[0] == "0":
            out.append("zero")
        return out
    if not token[0].isalpha():
        return [*out, "w" + token]
    known = low in common
    if low in _NUMBER_WORDS:
        return [*out, "num", "w" + low]
    out += ["k1" if known else "k0", "f" + low[-3:], "g" + low[-4:], ("T" if token.istitle() else "U" if token.isupper() else "L") + ("k" if known else "r")]
    if known or len(low) < 4:
        out.append("w" + low)
    else:
        out.append("p" + low[:3])
    if len(token) == 1:
        out.append("one")
    return out


class Features:
    def __init__(self, common: frozenset[str]) -> None:
        self.common = common

    def __call__(self, token: str) -> list[str]:
        return _features(token, self.common)


# The labelled table: frames with slots, and what fills them. All of it is made up here; no text of any data set is in it.
_NAME_FRAMES = """my name is {n}|the name's {n}|I am {n}|I'm {n}.|this is {n}|it's {n} again|{n} here|{n} speaking|you are talking to {n}|people call me {n}|I go by {n}|{greet} {n}|{greet}, {n} here|{greet} {n} this side|{greet} {t} {n},
{close}, {n}|{close} {n}|{close}, {t} {n}|– {n}|- {n}|signed: {n}|{field}: {n}|{field} - {n}|{field} {n}|my {rel} {n} {did}|My {rel} {n} {did}.|my {rel}, {n}, {did}|{n} is my {rel}|{t} {n} {did}|{n} {did}.|I {met} {n} {when}.|I {met} {t} {n} {when}.|we {met} {n}|please {ask} {n} about the {thing}
please {ask} {t} {n}|{ask} {n}|{ask} {n} {when}|(for {n})|(on behalf of {n})|writing on behalf of {n}|the {thing} of {n}|a {thing} for {n}|the {thing} is in the name of {n}|booked under {n}|{ask} {n} to the {thing}|please {ask} {t} {n} to the {thing}|this is {n} from {S}|{n} from the {thing}|I am {n} from {P}|this is {n}, {S}|Is {n} there?|does {t} {n} know?|where is {n}|{n} has the {thing}.|{n}, my {rel}, {did}
Je suis {n}.|Mon nom est {n}.|Je m'appelle {n}|Mein Name ist {n}.|Hier spricht {n}.|Ich bin {n}|Mi nombre es {n}.|Soy {n}|Me llamo {n}|मेरा नाम {n} है|मैं {n} हूँ।|mera naam {n} hai|main {n} bol raha hoon|yahan {n} hai|मेरे {hrel} {n} ने बताया।|{n} जी से बात हुई।|{n} ने कहा।|我叫{n}。|我是{n}。""".replace("\n", "|").split("|")
_PHONE_FRAMES = """{ring} {p}|{ring} me on {p}|{ring} me at {p} {when}.|{ring} my {rel} on {p}|{ring} my {rel}, {p}.|my number: {p}|my number is {p}|{nr} {p}|{nr}: {p}|{nr} is {p}.|{nr} - {p}|{nr}. {p}|({p})|{p} is my {nr}|or {ring} {p}, {when}|new {nr} {p}, the old one is gone|reachable under {p}|tel:{p}
Mon numéro : {p}|Meine Nummer: {p}|Ruf mich unter {p} an.|Mi número: {p}|Llámame al {p}.|Appelez-moi au {p}.|मेरा नंबर {p}|मेरा नंबर {p} है।|मेरे {hrel} का नंबर {p} है।|फ़ोन: {p}|mera number {p} hai|is par call karo: {p}|我的电话是{p}。|电话：{p}""".replace("\n", "|").split("|")
_MAIL_FRAMES = """{write} {m}|{write} {m} {when}.|please {write} {m}|my {addr} is {m}|my {addr}: {m}|{addr}: {m}|{addr} {m}|<{m}>|({m})|(<{m}>)|{m} is my {addr}|mailto:{m}|I signed up with {m}|it went to {m} instead|copy to {m} please|or to {m}, {when}|I {joined} with {m}|{joined} as {m}|I {joined} with {m} {when}|who uses {m}?|{m} does not work|my {rel} has {m}|{thing} for {m}
Mon adresse est {m}.|Meine Adresse: {m}|Mi correo: {m}|Schreiben Sie an {m}.|मेरा ईमेल {m}|मेरा ईमेल {m} है।|mera email {m} hai|我的邮箱是{m}。""".replace("\n", "|").split("|")
_ID_FRAMES = """{doc} {i}|{doc} {i}.|{doc}: {i}|{doc} no. {i}|{doc} number {i}|{doc} number is {i}|my {doc} {i}|my {doc} is {i}|my {doc} number: {i}|({doc} {i})|(my {doc}: {i})|{i} is my {doc}|on my {doc} it says {i}|for proof, {doc} {i}.|{say}: {doc} {i}|{say}, {doc} no. {i}|{say} - my {doc} is {i}
I hold {doc} {i}|I hold the {doc} {i}, see the copy.|travelling with {doc} {i}|we need it for the {doc} {i}|my {rel} has {doc} {i}|enrolled as {i}|enrolled under {i}|registered under no. {i}|I am registered under {i}.|Mon passeport : {i}|Ausweis Nr. {i}|Mi pasaporte es {i}|मेरा आधार {i} है।|mera PAN {i} hai|护照号{i}""".replace("\n", "|").split("|")
_ADDRESS_FRAMES = """I live at {a}|I live at {a}.|we live in {a}|my home: {a}|home: {a}|{haddr}: {a}|{haddr} {a}|my {haddr} is {a}.|we moved to {a}|I moved to {a} {when}.|{send} the {thing} to {a}|{send} it to {a}, please.|please {send} the {thing} to {a}.|my {rel} lives at {a}|my {rel} stays at {a}.|I stay at {a}|staying at {a} {when}|the flat is at {a}|{a} is where I live
J'habite {a}.|Ich wohne {a}.|Meine Adresse ist {a}.|Vivo en {a}.|मैं {a} में रहता हूँ।|मेरा पता: {a}|mera pata {a} hai|我住在{a}。""".replace("\n", "|").split("|")
_PLAIN = """The {thing} is {adj}.|Is the {thing} {adj}?|is the {thing} open {when}|What does the {thing} cost?|how much is the {thing} for {S}|How do I get a {thing}?|where can i find the {thing}|When does the {thing} start?|The {thing} costs {money}.|I paid {money} for the {thing} on {d}.|paid {money} already|We need {N2} copies of the {thing}.|You get {N2}% back.
{N2} of {N4} places are left.|The {thing} opens at {h} and closes at {h}.|It starts on {d}.|{P} {B} is {adj}.|{P} {B} opens at {h}.|The {thing} is in {P} {B}.|Room {N3}, {P} {B}.|room {N3} is {adj}|Meet at {P} {B} at {h}|the {thing} near {P} {B} is {adj}|From {P} to {P} it takes {N2} minutes.|I come from {P}.|I am from {P}|I am {adj}.|I am a student|I am in {S}|This is {adj}.|this is about the {thing}
It's {adj} again.|I {met} the {thing} team {when}.|please {ask} the {role} about the {thing}|The {role} {did}.|the {role} of {P} {B} {did}|my {rel} {did}|My {rel} will pay.|{greet}|{greet}, is the {thing} open?|{greet} everyone,|{close}|{close}, the {role} team|The {num} no. {N8} is missing.|{num} {N6} is late|{num} no. {N10} dated {d}|{num} number {N7}|my {num} is {N6}|{num} {c}{N8}|{num} {C}-{N8} is {adj}
{num} {N4}/{N2}|the course {c} is {adj}|{c} has {N1} credits|{c} is taught at {h}|version {N1}.{N2}|See https://{pl}.example/{N4} for the {thing}.|https://www.{pl}.example/?id={N8}|follow @{pl}_news|@{pl} posted it|is it @ {h}?|score {N2}/{N3}|I ranked {N3}.|marks: {N2}%|{y}-{y}|the year {y}|{N12} as the {num}|the {num} says {N10}|Yes.|No, it is {adj}.|ok thanks|Thanks!|Please answer in German.|in Spanish please|Write it in Hindi
The {role} keeps the {thing} for {N2} days, and it is {adj} after that.|Every {thing} goes through {P} {B} first, then to the {role}.|{P} {B} and {P} {B} share one {thing}.|For {S} the {thing} is {money}; for {S} it is {money}.|Holders of a {g} in {S} pay {money}.|what is the fee of {g} {S}?|Does {g} {S} have a {thing}?|I want to study {S} after my {g}.|As an assistant I cannot say that.|Sorry, that is not something I can help with.|You can bring the {thing} to the {role}.|You are a helpful guide. Be brief.|Use these notes only.
A {adj} {thing} needs a {role}'s stamp, a photo and {N1} copies.|No {thing} is given out after {h}.|If the {thing} is {adj}, {ask} the {role} at {P} {B}.|Le {fr} est ouvert.|Quand ouvre le {fr} ?|La {frf} coûte {money}.|Le {fr} de {P} {B} ferme à {h}.|Der {de} ist offen.|Wann öffnet der {de}?|Der {de} in {P} {B} kostet {money}.|El {es} está cerrado.|¿Cuándo abre el {es}?|El {es} de {P} {B} cuesta {money}.|{hi} कब खुलेगा?|{hi} की कीमत {money} है।|{P} {B} में {hi} है।|{hr} kab khulega|{hr} {money} ka hai|haan, {hr} {P} {B} mein hai|{zh}什么时候开门？|{zh}的费用是{money}。|{P} {B}有{zh}。
we took {N2} photos at {P} {B}|the {P} team won|the {P} road is closed|{P} is {adj}, but far|bus {N2} to {P}|seat {N2}, row {N1}|locker {N3}|table {N2}|page {N3} of {N3}|gate {N1} at {P} {B}|Press {N1} to go on.|{N3} people came {when}|at {h} on {d}|until {d}|between {d} and {d}|{S} and {S}|only {g} holders|Does {P} {B} have {adj} {things}?|does it have {things}|{adj} {things} cost {money}.|Are the {things} {adj}?|{N2} {things} are {adj}.|no {things} {when}|Which {things} do I need?|{things}, {things} and {things} are {adj}|it rained in May|we leave in June or July|pay by {d} or later|Grace period: {N2} days|I do not want to say more|please respond soon|let me know|who can help me with this|does it go to {P}?|does this train stop at {P} {B}|trips to {P} start on {d}|ask about {P}; it is {adj}|they plan a tour to {P}|the {adj} {thing} of {P} {B}|Apologies for that.|My apologies, it is {adj}.|in {S}, {S} or {S}|holders of {g} {S} get {N2}%|As a {adj} {role} I cannot judge that.|no idea why|it depends on the {thing}|the rest is {adj}|this has been {adj} since {d}|यह {hi} सबके लिए खुला है।|कृपया कल फिर आइए।|नियम अगले महीने बदलेंगे।|{hi} की सूची यहाँ देखें।|पैसे {d} तक जमा कर दीजिए।|इसमें {N2} दिन लगते हैं।|मुझे {hi} के बारे में पूछना है।|अधिक जानने के लिए {hi} में पूछिए।|क्या {hi} आज बंद है?|धन्यवाद, काम हो गया।|सभी छात्र {hi} में अपना पत्र दें।|yeh kaam kal tak ho jayega|paisa wapas nahi milta|{hr} ke liye {money} dena padta hai|mujhe {hr} ka samay batao|khana aur rehna alag hai|kya {hr} aaj band hai|theek hai, shukriya|aap kal aa sakte hain|{N2} din lagenge|请稍等一下。|更多内容请看网站。|{zh}今天关门。|所有人都可以用{zh}。|费用要在{d}以前交。|谢谢你的帮助。|我想了解{zh}。|{zh}有{N3}个位子。|请问{zh}怎么走？|这需要{N2}天。|Il faut attendre {N2} jours.|Tout le monde peut venir.|Merci beaucoup pour votre aide.|Les prix changent chaque année.|On paie {money} à l'entrée.|Man muss {N2} Tage warten.|Alle dürfen kommen.|Vielen Dank für die Hilfe.|Die Preise ändern sich jedes Jahr.|Hay que esperar {N2} días.|Todos pueden venir.|Muchas gracias por la ayuda.|Los precios cambian cada año.|Department of {S}|the {S} lab|School of {S}, {P} {B}""".replace("\n", "|").split("|")
#: What the small slots hold.
_SLOTS = {
    "greet": "hi hello hey|good morning|good evening|dear|greetings|namaste|bonjour|hallo|hola|hi there|Hello|Hi|Hey|Dear|Good day|Attn.|cc|To|From",
    "close": "regards|Regards|thanks|Thanks|thank you|Thank you|cheers|yours|Yours|best wishes|kind regards|sincerely|Yours truly|many thanks|merci|Gruß|gracias|dhanyavaad",
    "field": "name|Name|full name|Applicant|applicant name|student|Student|guardian|Guardian|father's name|mother|contact|contact person|nominee|signed|sender|account holder|author|witness|visitor|guest|tenant|holder|payer|caller|NAME",
    "rel": "brother|sister|father|mother|dad|mum|friend|best friend|roommate|flatmate|cousin|uncle|aunt|wife|husband|son|daughter|colleague|neighbour|teacher|boss|landlord|doctor|niece|nephew|classmate|senior|batchmate|guardian|grandfather",
    "hrel": "भाई|पिता|दोस्त|मित्र|चाचा",
    "did": "will call|can sign|paid for it|came along|filled it in|has the papers|told me so|said yes|wrote this|is waiting|will come tomorrow|sent it|called back|asked for it|signed the letter|was at the desk|helped me|knows about it|refused|left early|wants a copy|gave me the form|is ill|is away|has a question|did it",
    "met": "met|saw|called|asked|spoke to|spoke with|talked to|wrote to|phoned|visited|told|know|emailed|thanked|waited for",
    "when": "yesterday|today|tomorrow|last week|on Monday|after six|in the evening|this morning|at noon|any time|before ten|next week|soon|now|on Friday|tonight",
    "ask": "ask|tell|call|contact|inform|add|remind|thank|include|email|help|check with|speak to|write to|reach|inform|note that",
    "ring": "call|Call|ring|Ring|phone|text|Text|whatsapp|sms|dial|message|try|reach|contact",
    "nr": "phone|Phone|mobile|Mobile|cell|tel|Tel|telephone|landline|whatsapp|WhatsApp|number|contact|contact number|contact no|Ph|mob|Mob|fax|office phone|home phone",
    "joined": "registered|logged in|subscribed|applied|ordered|signed in|joined|paid|enrolled|wrote",
    "write": "write to|mail|email|Email|send it to|reply to|answer to|forward it to|send a copy to|contact|write me at|mail me at|reach me at|cc",
    "addr": "email|Email|e-mail|E-mail|mail|mail id|email id|address|mail address|email address|gmail|contact|id|inbox|login|username",
    "doc": "passport|Passport|identity card|ID card|ID|national ID|national identity card|driving licence|driver's license|licence|DL|PAN|PAN card|tax number|tax ID|Tax ID|tax card|taxpayer number|Aadhaar|aadhaar card|voter card|voter ID|enrolment|enrolment number|enrolment no.|student ID|student card|student number|roll|roll number|registration number|matriculation|social security|residence permit|visa",
    "say": "for the record|For your records|details|Details|in short|as asked|As asked|they wanted proof|to confirm|for verification|here it is|note|so you know",
    "haddr": "address|Address|home address|postal address|permanent address|my place|residence|delivery address|mailing address|house|new address",
    "send": "send|Send|post|Post|courier|mail|deliver|ship|forward|bring|return",
    "thing": "form|letter|fee|receipt|key|card|pass|book|list|office|desk|lab|library|hall|bus|mess|bill|ticket|ticket desk|parcel|certificate|notice|report|exam|class|course|seat|room|bed|locker|scholarship|deposit|refund|grant|hostel|gym|canteen|website|portal|app|password|photo|signature|interview|result|timetable|holiday|festival|match|club|permit|bond|loan|discount|waiver|badge|laptop|charger|umbrella|bicycle|meal|parking|shuttle|printer|projector",
    "adj": "open|single|double|shared|extra|private|public|annual|monthly|required|available|optional|special|regular|open|closed|late|full|new|old|broken|free|cheap|cold|hot|noisy|quiet|ready|lost|wrong|right|empty|busy|slow|small|large|clean|locked|far|near|missing|pending|confusing|fine|sure|sorry|happy|tired|worried|confused|glad|ready now|not there|unclear|expired|valid|due",
    "role": "warden|clerk|dean|registrar|librarian|principal|secretary|guard|driver|cashier|coach|counsellor|nurse|editor|manager|officer|committee|council|lab assistant|head|director|help desk|front desk|hostel office|department",
    "num": "receipt|Receipt|order|Order|invoice|Invoice|bill|Bill|ticket|Ticket|challan|form|Form|application|transaction|Transaction|reference|Reference|parcel|token|slip|voucher|complaint|request|booking|case|shelf mark|coupon|serial|batch",
    "fr": "bureau|guichet|service|restaurant|dossier|foyer|bus", "frf": "chambre|bourse|carte|caution|bibliothèque|salle",
    "de": "Schalter|Antrag|Kurs|Saal|Bus|Raum|Platz|Ausweis", "es": "comedor|curso|plazo|despacho|autobús|formulario",
    "hi": "कार्यालय|पुस्तकालय|फॉर्म|छात्रावास|पाठ्यक्रम", "hr": "office|hostel|form|library|mess|counter", "zh": "图书馆|宿舍|办公室|食堂|课程",
}
_SLOTS = {k: v.split("|") for k, v in _SLOTS.items()}
_SLOTS["things"] = [x + "s" for x in _SLOTS["thing"]]
#: Every so-many-th frame of a kind is kept for testing, with all its fillings.
HELD_OUT = 6

_ONSET = "b bl br c ch cl d dr f fl g gl gr h j k kl kr l m n p pr q r rh s sc sh sk st t tr v w x y z zh bh dh kh gh sv".split()
_VOWEL = "a a a e e e i i o o u u ai au ei ia io ou y".split()
_CODA = "b ck d ff k l ll m n nd ng nn r rd rt s sh st t th tz x".split()
_LAST = "a ez er in ic ova enko stein berg mann ley ford well sson sen ini elli ard eau oux ev ian jee nath wal pal rao reddy pur ya ko moto yama zadeh ullah".split()
_REAL = "Emma Liam Noah Mia Lucas Nora Hugo Clara Felix Ines Mateo Elena Diego Sofia Luc Chloe Karl Greta Jonas Wang Ling Hassan Layla Tariq Zainab Boris Natasha Vikram Lakshmi Suresh Neha Imran Pooja Manoj Alice Bob Henry Ruth Victor".split()
_PLACE = "Birch Falcon Granite Harbour Meadow Sunny Royal Queen King Garden Lake Spring Winter Summer East West South Upper Lower High Castle Church Mill Bridge Market Rose Lily Pine Ash Fox Wolf Eagle Lion Crystal Golden Iron Chalk Clay Sand Salt Crown Abbey".split()
_PLACE_END = " bury ton ford ham wood ley ville borough port mouth by wich stow hurst cliff hill bank side view fort pool bay land water mead".split(" ")
_BUILDING = "Hall Wing Court House Block Building Annexe Hostel Centre Library Tower Lodge Pavilion Theatre Auditorium Arena Gate Canteen".split()
_STREET = "Street Road Lane Marg Path Nagar Avenue Colony Way Close Crescent Enclave Drive Square Terrace Chowk Gali".split()
_SUBJECT = "Mathematics Law Medicine Music Philosophy Geology Botany Sociology Psychology Journalism Architecture Marketing Finance Zoology Literature Drama Dentistry Pharmacy Astronomy Anthropology".split()
_FIELD = "Modern Advanced Social Public Pure General Clinical Global Digital Human Natural Early Comparative Political Visual Molecular Nuclear Legal Sports Business".split()
_DEGREE = "B.A.|B.Sc.|B.Tech|B.Des.|BBA|M.A.|M.Sc.|M.Tech|MBA|Ph.D.|Diploma|Certificate".split("|")


class _Filler:
    """Fills the slots of carriers at random; marks the personal ones."""

    def __init__(self, seed: int) -> None:
        self.r = np.random.default_rng(seed)

    def of(self, xs):
        return xs[int(self.r.integers(len(xs)))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.r.integers(0, 10, n)))

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def word(self, n: int) -> str:
        return ("".join(self.of(_ONSET) + self.of(_VOWEL) for _ in range(n)) + (self.of(_CODA) if self.chance(0.4) else self.of(_LAST) if self.chance(0.5) else "")).capitalize()

    def name(self) -> str:
        first = self.of(_REAL) if self.chance(0.15) else self.word(int(self.r.integers(1, 4)))
        last = self.word(int(self.r.integers(1, 4)))
        form = self.r.random()
        text = (f"{first} {last}" if form < 0.5 else f"{last}, {first}" if form < 0.58 else f"{first[0]}. {last}" if form < 0.68 else first if form < 0.82 else last if form < 0.9 else f"{first} {last[0]}." if form < 0.94 else f"{first} {self.word(1)} {last}")
        return self.cased(text, 0.15, 0.1)

    def cased(self, text: str, low: float, high: float) -> str:
        x = self.r.random()
        return text.lower() if x < low else text.upper() if x < low + high else text

    def phone(self) -> str:
        d = self.digits
        return self.of([f"+91 {d(5)} {d(5)}", f"+91-{d(5)}-{d(5)}", f"+91{d(10)}", f"0091{d(10)}", d(10), f"0{d(3)}-{d(7)}", f"({d(3)}) {d(3)}-{d(4)}", f"0{d(4)} {d(6)}", f"{d(5)} {d(5)}", f"{d(3)}-{d(3)}-{d(4)}", f"+44 {d(4)} {d(6)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1 ({d(3)}) {d(3)} {d(4)}", "".join(_DIGITS[int(c)] for c in d(10)), " ".join(_NUMBER_WORDS[int(c)] for c in d(10)), " ".join(_NUMBER_WORDS[int(c)] for c in d(10)), "-".join(d(10)), " ".join(d(10)), f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"{d(4)}-{d(6)}"])

    def email(self) -> str:
        a, b = self.word(int(self.r.integers(1, 4))).lower(), self.word(int(self.r.integers(1, 3))).lower()
        user = self.of([f"{a}.{b}", f"{a}_{b}", f"{a[0]}{b}", f"{a}{self.digits(2)}", f"{a}-{b}", f"{a}.{b}+news", a])
        host = self.of(["mailbox.test", f"{b}.invalid", "web.city.test", "corp.example.io", f"mail.{b}.co.uk", f"{b}mail.com", f"{b}.org", "dept.college.ac.in", "box.example.fr"])
        x = self.r.random()
        if x < 0.7:
            return self.cased(f"{user}@{host}", 0.0, 0.12)
        at, dot = self.of([(" [at] ", " [dot] "), (" AT ", " DOT "), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" @ ", " . "), (" {at} ", " {dot} ")])
        return user + at + host.replace(".", dot)

    def id_number(self) -> str:
        d, L = self.digits, lambda n: "".join(chr(65 + int(x)) for x in self.r.integers(0, 26, n))
        return self.of([d(12), f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}", f"{L(1)} {d(7)}", f"{L(1)}{d(7)}", f"{L(5)}{d(4)}{L(1)}", f"{L(2)}-{d(2)} {d(11)}", f"{L(2)}{d(13)}", f"{L(2)}/{d(7)}", f"{L(2)}/{d(9)}", f"{L(2)}/{d(10)}", f"{L(2)}{d(10)}", d(7), f"{L(5)}{d(4)}{L(1)}", f"{L(5)}{d(4)}{L(1)}".lower(), f"{L(2)}{d(8)}", f"/{d(7)}", f"/{d(8)}", f"/{d(8)}", d(8), d(9), f"{L(2)} {d(6)} {L(1)}", f"{L(3)}{d(7)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(2)}{L(2)}{d(4)}", f"{L(2)}-{d(8)}", f"/{d(10)}", f"{L(5)} {d(4)} {L(1)}", f"{d(4)}/{L(3)}/{d(5)}"])

    def place(self) -> str:
        return self.of(_PLACE) + self.of(_PLACE_END)

    def address(self) -> str:
        n, street, town, pin = str(int(self.r.integers(1, 200))), f"{self.of(_PLACE)} {self.of(_STREET)}", self.place(), self.digits(6)
        sep = self.of([", ", ", ", ",\n", ", "])
        text = self.of([
            f"{n}, {street}, {town} {pin}", f"{n}, {street}{sep}{town} - {pin}", f"Plot {n}{sep}{street}{sep}{town} {pin}", f"Flat {n}{self.of('ABCDE')}, {self.place()} Apartments, {street}, {town} - {pin}", f"H.No. {n}/{self.digits(2)}, Sector {self.digits(1)}, {town}",
            f"house {n} on {street}, near the old mill, {town}", f"H.No. {n}/{self.digits(2)}, Sector {self.digits(2)}, {town} {pin}", f"{n} {street}, {town}", f"No. {n}, {street}, behind the bank, {town} {pin}", f"{street} {n}, {pin} {town}", f"Door {n}, {street}, {town}", f"{n}/{self.digits(2)} {street}{sep}{town} {pin}", f"house no {n}, {street}, {town}"])
        return self.cased(text, 0.12, 0.05)

    def plain(self, slot: str) -> str:
        if slot[0] == "N":
            return self.digits(int(slot[1:]))
        r = self.r
        if slot in _SLOTS:
            return self.of(_SLOTS[slot])
        match slot:
            case "money":
                return self.of(["Rs. {}", "Rs {}", "₹{}", "INR {}", "{} rupees", "${}", "€{}", "{}/-"]).format(self.of([f"{r.integers(1, 99)},{self.digits(3)}", f"{r.integers(1, 20)},{self.digits(2)},{self.digits(3)}", self.digits(3), self.digits(4), self.digits(5), self.digits(6)]))
            case "c" | "C":
                return self.of(["CS", "BT", "ME", "HM", "EC", "PH"]) + self.of(["-", " ", ""]) + self.digits(3)
            case "pl":
                return self.place().lower()
            case "P":
                return self.place()
            case "B":
                return self.of(_BUILDING)
            case "S" | "s":
                return f"{self.of(_FIELD)} {self.of(_SUBJECT)}"
            case "g":
                return self.of(_DEGREE)
            case "h":
                return self.of([f"{r.integers(1, 12)} pm", f"{r.integers(7, 22):02}:{self.of(['00', '15', '30'])}", f"{r.integers(1, 12)}:30 am"])
            case "d":
                return self.of([f"{r.integers(1, 29)} {self.of(['May', 'June', 'July', 'March', 'October', 'December'])}", f"{r.integers(1, 29)} {self.of(['May', 'April', 'August', 'January'])} {r.integers(2021, 2028)}", f"{r.integers(2021, 2028)}-{r.integers(1, 13):02}-{r.integers(1, 29):02}", f"{r.integers(1, 29):02}/{r.integers(1, 13):02}/{r.integers(2021, 2028)}"])
            case "y":
                return str(r.integers(2021, 2030))
            case "r":
                return self.of([f"{r.integers(1, 99)},{self.digits(3)}", f"{r.integers(1, 20)},{self.digits(2)},{self.digits(3)}"])
            case "t":
                return self.of(["Mr", "Ms", "Mrs", "Dr", "Prof.", "Mr.", "Ms.", "Dr.", "Shri", "Smt."])
        raise KeyError(slot)

    def spell(self, carrier: str) -> list[tuple[str, str]]:
        """(text, kind or O) pieces of a filled carrier."""
        out = []
        for n, part in enumerate(re.split(r"\{(\w+)\}", carrier)):
            if n % 2 == 0:
                out.append((part, "O"))
            elif part in "npmia":
                kind = {"n": "name", "p": "phone", "m": "email", "i": "id_number", "a": "address"}[part]
                out.append(({"n": self.name, "p": self.phone, "m": self.email, "i": self.id_number, "a": self.address}[part](), kind))
            else:
                out.append((self.plain(part), "O"))
        return out


def _frames(held_out: bool) -> list[list[str]]:
    """The frames of each kind and the plain ones, those kept for testing or the others."""
    return [[x for n, x in enumerate(kind) if (n % HELD_OUT == 0) == held_out] for kind in (_NAME_FRAMES, _PHONE_FRAMES, _MAIL_FRAMES, _ID_FRAMES, _ADDRESS_FRAMES, _PLAIN)]


def labelled_table(n: int = EXAMPLES, seed: int = 11, held_out: bool = False) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The labelled table: (text, spans) of made-up messages, of the frames for training or of those kept for testing."""
    f = _Filler(seed)
    *kinds, plain = _frames(held_out)
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(f.r.integers(1, 5))):
            frame = f.of(plain) if f.chance(0.55) else f.of(kinds[int(f.r.choice(5, p=[0.34, 0.15, 0.13, 0.2, 0.18]))])
            if text:
                text += f.of([" ", " ", " ", ". ", ", ", "\n", " - "])
            if f.chance(0.5):
                frame = frame[0].upper() + frame[1:]
            for piece, kind in f.spell(frame):
                if kind != "O":
                    spans.append((len(text), len(text) + len(piece), kind))
                text += piece
            if f.chance(0.3) and text[-1].isalnum():
                text += f.of([".", ".", "!", ",", "?", ""])
        if not spans and len(text) > 20 and f.chance(0.2):  # broken off, perhaps inside a word
            text = text[: int(f.r.integers(15, len(text)))]
        if f.chance(0.1):
            text = text.lower() if f.chance(0.6) and len(text.lower()) == len(text) else text.upper() if len(text.upper()) == len(text) else text
        out.append((text, spans))
    return out


def tagged(text: str, spans: list[tuple[int, int, str]]) -> tuple[list[str], list[int]]:
    words, y = [], []
    for a, b in tokens_of(text):
        label = "O"
        for s, e, kind in spans:
            if s <= a and b <= e:
                label = ("B-" if a == s or not y or not LABELS[y[-1]].endswith(kind) else "I-") + kind
        words.append(text[a:b])
        y.append(LABELS.index(label))
    return words, y


def train(common: frozenset[str]) -> Chain:
    """The model for messages whose common words are these. Words of the table's carriers are common too."""
    own = {w.lower() for kind in _frames(False) for c in kind for w in re.findall(r"[^\W\d_]{2,}", re.sub(r"\{\w+\}", " ", c))}
    own |= {w.lower() for x in (*_SLOTS.values(), _BUILDING, _STREET, _SUBJECT, _FIELD) for c in x for w in re.findall(r"[^\W\d_]{2,}", c)}
    return Chain(LABELS, Features(common | frozenset(own))).fit([tagged(t, s) for t, s in labelled_table()])


@lru_cache(maxsize=2)
def _trained(common: frozenset[str]) -> Chain:
    return train(common)


_ID_WORDS = re.compile(r"passport|licen[cs]e|identity|\bid\b|\bids\b|enrol|student|national|tax|pan\b|aadhaar|aadhar|card|roll|registration|पहचान|आधार|voter|security|matric|dl\b|ssn|proof|\brecord\b", re.I)
_NOT_ID = re.compile(r"(?:order|receipt|challan|form|course|room|ticket|invoice|parcel|transaction|application|version|bill)\s*(?:no\.?|number|is|code)?[\s:#.\-]*(?:is)?\s*(?:[A-Z]{2}[\s\-]?\d*[\s\-]?)?$", re.I)
_DIALLED = re.compile(r"^(?:0\d{2,4}-\d{6,7}|\+\d[\d \-]{8,}|\(\d{3}\) ?\d{3}-\d{4})$")
_DATE = re.compile(r"^\W*(?:\d{4}-\d{1,2}(?:-\d{1,2})?|\d{1,2}[/.]\d{1,2}[/.]\d{4})\W*$")
_STREET_WORD = re.compile(r"\b(?:street|road|lane|marg|path|nagar|avenue|colony|way|close|crescent|enclave|apartments?|sector|plot|flat|house|h\.? ?no|door|pin|apt)\b", re.I)


#: A hall's name ends, or goes on, with such a word.
_HALL = re.compile(r"(?:hall|wing|court|house|block|building|annexe|hostel|centre|library|tower|lodge|department|school|institute)\b", re.I)
#: The verb, not the street.
_CLOSE = re.compile(r"\bclose (?:on|at|by|in|from|until)\b", re.I)


def plausible(kind: str, span: str, before: str, after: str = "") -> bool:
    """The exact form of a span of its kind."""
    digits = sum(c.isdigit() for c in span)
    if kind == "email":
        return ("@" in span or re.search(r"\bat\b|\[at\]|\(at\)", span, re.I) is not None) and len(span) > 6
    if kind == "phone":
        return 7 <= digits + len(_SPELLED.findall(span)) <= 15 and not _NOT_ID.search(before)
    if kind == "id_number":
        letters = sum(c.isalpha() for c in span)
        return (digits >= 5 or (digits >= 4 and letters >= 4)) and len(span) < 40 and not _DATE.search(span) and not _NOT_ID.search(before)
    if kind == "address":
        return digits >= 1 and not _CLOSE.search(span) and (bool(_STREET_WORD.search(span)) or span.count(",") >= 1)
    if len(re.findall(f"[{_CJK}]", span)) > 4:
        return False
    if _HALL.match(after.lstrip()) or _HALL.fullmatch(span.split()[-1]):
        return False
    return digits == 0 and re.search(r"[^\W\d_]{2}", span) is not None and "@" not in before[-1:]


def spans_of(text: str, spots: list[tuple[int, int]], labels: np.ndarray) -> list[tuple[int, int, str]]:
    """Checked spans of a labelled text. Neighbouring stretches of one kind within a few signs are one span."""
    out: list[tuple[int, int, str]] = []
    for (a, b), y in zip(spots, labels):
        if y == 0:
            continue
        kind = LABELS[y][2:]
        if out and out[-1][2] == kind and (LABELS[y][0] == "I" or a - out[-1][1] <= 1) and a - out[-1][1] <= 3:
            out[-1] = (out[-1][0], b, kind)
        else:
            out.append((a, b, kind))
    # Numbers written as telephones are telephones, whatever stood before them.
    out = [(a, b, "phone" if k == "id_number" and _DIALLED.match(text[a:b]) else k) for a, b, k in out]
    return [s for s in out if plausible(s[2], text[s[0] : s[1]], text[max(0, s[0] - 40) : s[0]], text[s[1] : s[1] + 14])]


def common_words(messages: DataFrame) -> frozenset[str]:
    """Words on at least COMMON_SHARE of the messages: at most words-per-message / COMMON_SHARE."""
    texts = messages.select("content").filter("content IS NOT NULL")
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("content"), r"[^\p{L}\p{M}]+"))).alias("w")).filter(F.length("w") > 1)
    least = texts.count() * COMMON_SHARE
    return frozenset(r["w"] for r in words.groupBy("w").count().filter(F.col("count") >= max(8.0, least)).collect())


def _finder(messages: DataFrame):
    model = _trained(common_words(messages))
    return messages.sparkSession.sparkContext.broadcast(model)


def personal_spans(messages: DataFrame) -> DataFrame:
    """(id, kind, start, end) of every piece of personal information in content; offsets count code points.

    Null, empty and blank content have none. Repeated rows of an id give each span once.
    """
    model = _finder(messages)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spots = [tokens_of(t) for t in texts]
            labels = work.decode([[t[a:b] for a, b in s] for t, s in zip(texts, spots)])
            rows = [(i, k, a, b) for i, t, s, y in zip(batch.column(0).to_pylist(), texts, spots, labels) for a, b, k in spans_of(t, s, y)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["id", "kind", "start", "end"])

    return messages.select("id", "content").mapInArrow(find, "id string, kind string, start int, end int").distinct()  # spans only, no texts


def found_kinds(messages: DataFrame) -> DataFrame:
    """(id, kind) of ``personal_spans``."""
    return personal_spans(messages).select("id", "kind").distinct()


def redacted(messages: DataFrame) -> DataFrame:
    """(id, content) with every piece of personal information replaced by its placeholder, like [EMAIL]; null stays null."""
    model = _finder(messages)

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = model.value
        for batch in batches:
            given = batch.column(1).to_pylist()
            texts = [t or "" for t in given]
            spots = [tokens_of(t) for t in texts]
            labels = work.decode([[t[a:b] for a, b in s] for t, s in zip(texts, spots)])
            out = []
            for raw, t, s, y in zip(given, texts, spots, labels):
                for a, b, k in reversed(spans_of(t, s, y)):
                    t = f"{t[:a]}[{k.upper()}]{t[b:]}"
                out.append(None if raw is None else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "content"])

    # One row of each id and text.
    one = messages.select("id", "content").groupBy("id", F.xxhash64("content").alias("_h")).agg(F.min("content").alias("content"))
    return one.select("id", "content").mapInArrow(hide, "id string, content string")
