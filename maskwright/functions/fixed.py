"""Patterns, word lists and formats that results depend on. Stated as they are, in natural order."""

from __future__ import annotations

# ---- dates
MONTHS = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|"
    r"Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DATE = (
    rf"(?:\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}"
    rf"|\d{{1,2}}(?:st|nd|rd|th)?[ -]{MONTHS}\.?,?[ -]\d{{4}}"
    rf"|{MONTHS}\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}})"
)

# ---- what must not stand before a match
VERSION_CUE = r"\b(?:v|ver|version|firmware|build|release|rev|patch|sdk|api|python|java|node)\.?\s*$"
ID_CUE = r"(?:order|ticket|invoice|awb|tracking|txn|transaction|ref|reference|case|\bid|#)\s*(?:id|no|number)?\.?\s*[:#-]?\s*$"
PHONE_CUE = (
    r"(?:tel(?:ephone)?|phone|mobile|mob|fax|whatsapp|call(?:\s+me)?(?:\s+(?:on|at))?|"
    r"reach(?:\s+me)?(?:\s+at)?|contact\s+(?:no|number))\.?\s*(?:no\.?)?\s*[:\-–]?\s*"
)
CONTEXT_CHARS = 30

# ---- Verhoeff's tables: the dihedral group of order 10, and the permutation applied at each place
VERHOEFF_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)

# ---- addresses
STATES = (
    "Andhra Pradesh|Arunachal Pradesh|Assam|Bihar|Chhattisgarh|Goa|Gujarat|Haryana|Himachal Pradesh|Jharkhand|Karnataka|Kerala|"
    "Madhya Pradesh|Maharashtra|Manipur|Meghalaya|Mizoram|Nagaland|Odisha|Punjab|Rajasthan|Sikkim|Tamil Nadu|Telangana|Tripura|"
    "Uttar Pradesh|Uttarakhand|West Bengal|Delhi|New Delhi|Jammu and Kashmir|Chandigarh|Puducherry|Ladakh"
)
CITIES = frozenset(
    """mumbai pune delhi bengaluru bangalore chennai kolkata hyderabad ahmedabad surat jaipur lucknow nagpur indore bhopal thane nashik
    vadodara raigad kochi coimbatore gurugram gurgaon noida navi bandra vikhroli chandigarh patna kanpur ludhiana agra visakhapatnam
    panvel ahmednagar aurangabad kolhapur""".split()
)
PIN = r"(?:(?<=[\-–—,] )(?<![\d,.])[1-9]\d{2} ?\d{3}(?![\d,]\d)|(?<=[\-–—,])(?<![\d,.])[1-9]\d{2} ?\d{3}(?![\d,]\d))"
US_ZIP = r"(?<=, [A-Z]{2} )(?<!\d)\d{5}(?:-\d{4})?(?!\d)"
PIN_BARE = r"(?<=[A-Za-z]{3} )(?<![\d,.])[1-9]\d{5}(?!\d)"
ADDRESS_TAIL = rf"(?:\s*,?\s*(?:{STATES}))?(?:\s*,?\s*India)?"
STATE_LINE = rf"^\s*(?:{STATES})(?:\s*,?\s*India)?\s*[.;]?\s*$"
ADDRESS_BOUNDARY = r"(?:[;:\n]|\b(?:at|to|from|is)\s(?=\d)|\bat\s(?=[A-Z]))"
ADDRESS_LOOKBACK = 220
ADDRESS_LEAD = " ,-–—\"'“‘("
ADDRESS_HINT = (
    r"\b(?:Plot|Unit|Floor|Road|Marg|Village|Taluka|Tower|Building|Campus|Society|Nagar|Gat|Survey|Sector|Phase|Area|MIDC|Dist|Wing|"
    r"Block|Colony|Opp|Opposite|Near|Next to|Off|Centre|Center)\b|\b[A-Z]-?\d{2,4}\b"
)

# ---- organisations
LEGAL = r"(?:Private\s+Limited|Pvt\.?\s+Ltd\.?|Limited|LIMITED|Ltd\.?|LLP|LLC|PLC|GmbH|Inc\.?|Corporation|Corp\.?)"
HEAD = r"(?:Bank|Trust|HUF|Group|Industries|Enterprises|Holdings|Technologies|Solutions|Systems|Associates|Partners|Sons|Brothers|Ventures)"
ORG_WORD = r"(?:[A-Z][\w&'’.\-]*|\([A-Z]\w*(?:\s+\w+)*\))"
ORG_LINK = r"(?:\s+and\s+|\s+|\s*&\s*)"
ORG = (
    rf"(?:\b(?:{ORG_WORD}{ORG_LINK}){{1,6}}(?i:{LEGAL})(?![\w])"
    rf"|\b(?:{ORG_WORD}{ORG_LINK}){{1,5}}(?:{HEAD})\b"
    r"|(?<!Reserve )\bBank\s+of\s+[A-Z]\w+(?:\s+[A-Z]\w+)?)"
)
ORG_CONJUNCTION = rf"(?:{LEGAL}|{HEAD})(\s+and\s+)(?=[A-Z])"
#: Leading words that don't belong to an organisation's name.
TRIM = frozenset(
    """the our we its their of and to by for in at on as with from such each all any this that these those book running lead manager
    managers brlm brlms registrar statutory auditor auditors sole joint offer company issuer sponsor escrow collection refund public
    account banker bankers anchor designated scheduled commercial nationalised peer reviewed independent chartered accountants legal
    counsel domestic international indian selling shareholder shareholders promoter promoters group director directors board committee
    person contact details name address note notes refer please further however accordingly also subsidiary subsidiaries associate
    material key managerial personnel senior management agreement agreements between among notwithstanding pursuant under upon whether
    which where while since until unless certain bid bids bidder bidders investor investors registered corporate office head branch
    short long term formerly known self-certified syndicate advisory investment electricals industrial solutions cash india limited
    private family trust bank co""".split()
)
#: Words that describe a business; they stay when it is renamed.
DESCRIPTORS = frozenset(
    """wealth management securities capital bank trust family finance financial services industries industrial park holdings enterprises
    company international india infrastructure power energy electricals electric engineering metal metals extrusion technologies
    solutions systems group investments investment partners associates pandit housing realty logistics foods pharma private limited ltd
    llp corporation corp inc huf pvt & and of the asset advisors advisory consultants consulting insurance life general mutual fund
    funds markets broking stock exchange depository sons brothers co motors project integrated transformer switchgear infra distriparks
    analytics ratings""".split()
)
#: Regulators, exchanges and other public bodies stay as they are.
PUBLIC_BODIES = (
    r"^(?:securities and exchange board|reserve bank|bse\b|national stock exchange|nse\b|national securities depository|"
    r"central depository services|national payments|registrar of companies|ministry of|government of|institute of chartered|"
    r"competition commission|indian bank association|rbi\b|sebi\b|nsdl|cdsl|npci|stock exchanges?|depositor(?:y|ies)|the companies act)"
)

# ---- people
PERSON_STOP = frozenset(
    """india indian private limited ltd llp bank trust family company capital securities services industries management wealth
    corporation industrial park holdings group huf pvt inc fund promoters promoter directors director investors bidders offer price
    equity shares share registrar manager managers committee board act rules regulations schedule section maharashtra pune mumbai delhi
    gujarat karnataka bengaluru chennai kolkata hyderabad village taluka marg road nagar chowk floor tower plaza east west north south
    branch email tel opp opposite hall chambers hospital apartment society colony complex garden estate building centre center house
    bhavan residency mantri yojana abhiyan mission bunglow bungalow gram kisan urja suraksha""".split()
)
TITLE = r"\b(?:Mr|Mrs|Ms|Miss|Dr|Shri|Smt|Sri)\.?\s+"
TITLED_NAME = r"(?:[A-Z][a-z'’\-]+)(?:\s+[A-Z][a-z'’\-]+){0,3}"
WORD = r"[^\W\d_](?:[^\W\d_]|['’\-])*\.?"
CONTEXT_CUES = (
    r"this is|my name is|i am|i'm|customer|client|user|dear|hi|hello|regards|thanks|thank you|sincerely|cheers|attn|attention|"
    r"contact person|contact"
)
CONTEXT_LEAD = rf"\b(?i:{CONTEXT_CUES})[ ,:\-]+"
CONTEXT_NAME = r"[^\W\d_a-z][^\W\d_]+(?:[ \-][^\W\d_a-z][^\W\d_]+){1,2}"
NEXT_WORD = r"^[ \t]+([A-Za-z][A-Za-z'’\-]{2,})\b"
NON_PROSE = r"(?i)\S+@\S+|(?:https?://|www\.)\S+|\b[a-z0-9-]+\.(?:com|co\.in|in|org|net)\b"
PLACE_SUFFIX = (
    r"(?i)^\s+(?:Marg|Road|Rd|Nagar|Chowk|Path|Street|St|Lane|Colony|Society|Vihar|Peth|Wadi|Complex|Park|Garden|Gardens|Estate|Hall|"
    r"Chambers|Hospital|Apartments?|Bunglow|Bungalow)\b"
)

# ---- replacements
ROLE_MAILBOXES = frozenset(
    """cs ipo investor investors grievance grievances info support contact connect compliance secretarial legal ir mbd ecm care help admin
    sales hr mail email""".split()
)
STATE_CODES = ("MH", "GJ", "KA", "TN", "DL", "UP", "WB", "RJ", "MP", "AP", "TS", "HR", "PN")
COUNTRY_CODES_3 = ("971", "966", "880", "977", "974", "965", "973", "968", "353", "852", "886")
DOCUMENTATION_BLOCKS = ("192.0.2", "198.51.100", "203.0.113")  # RFC 5737
LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
INITIALS = "ABCDEFGHJKLMNPRSTV"
LABELS = ("PERSON", "ORG", "LOCALITY", "EMAIL", "URL", "PHONE", "ADDRESS", "SSN", "CREDIT_CARD", "DOB", "IP_ADDRESS", "ID_NUMBER", "AADHAAR")

# ---- identity cards
ID_HINT = r"(?i)incometax|govt|governmentofindia|uniqueidentification|permanentaccount|aadhaar|dateofbirth|\bdob\b|male|female"
NAME_LABEL = r"(?i)(?:father|mother|husband|wife|guardian)?'?s?name$"
AADHAAR_LIKE = r"(?<!\d)[2-9]\d{3}\s?\d{4}\s?\d{4}(?!\d)"
FULL_DATE = r"(?<!\d)\d{1,2}[/.-]\d{1,2}[/.-]\d{4}(?!\d)"
RELATION = r"(?i)^(?:father|mother|husband|wife|guardian|s/?o|d/?o|w/?o|c/?o)\W*[:;\-]\s*(.+)$"
CARD_PIN = r"(?<!\d)\d{6}(?!\d)"
NOT_NAMES = (
    r"(?i)^(?:incometaxdepartment|govtofindia|governmentofindia|male|female|transgender|permanentaccountnumber(?:card)?|"
    r"uniqueidentification\w*|signature|address|name)$"
)
COVER_ABOVE, SIGNATURE_LEFT, SIGNATURE_ABOVE, ADDRESS_LINES, PAD = 1.3, 0.9, 3.4, 6, 4
