"""Tables of the engine: types, scores, keywords, domains.

All values in this module are fixed: results depend on them as they stand.
"""

from __future__ import annotations

ENTITY_TYPES = (
    "PERSON", "EMAIL", "PHONE", "LOCATION", "ORGANIZATION", "ADDRESS", "URL", "USERNAME", "PASSWORD", "SSN",
    "CREDIT_CARD", "IBAN", "BANK_ACCOUNT", "DATE", "IP_ADDRESS", "MISC", "SECRET", "HOSTNAME", "FILE_PATH", "IDENTIFIER",
)

# Patterns; \d, \w, \s and \b mean Unicode.
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = (
    r"(?:\+\d{1,3}[\s\-.]?\(?\d{1,4}\)?[\s\-.]?\d{1,4}[\s\-.]?\d{1,9}"
    r"|\(\d{2,5}\)[\s\-.]?\d{2,4}[\s\-.]?\d{2,9}"
    r"|\b\d{2,4}[\s\-.]\d{2,4}[\s\-.]\d{2,9}\b"
    r"|\b\d{2,5}[\s\-.]\d{6,12}\b)"
)
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CREDIT_CARD = r"\b(?:\d{4}[\s\-]?){3}\d{4}\b"
IP_ADDRESS = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
IBAN = r"\b[A-Z]{2}\d{2}[\s]?[\dA-Z]{4}[\s]?(?:[\dA-Z]{4}[\s]?){1,7}[\dA-Z]{1,4}\b"
DATE = (
    r"(?:\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b"
    r"|\b\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}\b"
    r"|\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},?\s+\d{4}\b)"
)

#: Recognizers in order: type, pattern, base score.
RECOGNIZERS = (
    ("EMAIL", EMAIL, 0.95),
    ("PHONE", PHONE, 0.70),
    ("SSN", SSN, 0.80),
    ("CREDIT_CARD", CREDIT_CARD, 0.75),
    ("IP_ADDRESS", IP_ADDRESS, 0.85),
    ("IBAN", IBAN, 0.80),
    ("DATE", DATE, 0.60),
)

URL = r"""(?i)\b(?:[a-z][a-z0-9+\-]{1,15}://|www\.)[^\s<>"'`{}|\\^\[\]]+"""
URL_SCORE = PATH_SCORE = INTERNAL_HOST_SCORE = HOME_USER_SCORE = 0.85
UNC_PATH = r"""\\\\[\w.\-$]+(?:\\[^\\/:*?"<>|\s]+)+"""
WINDOWS_PATH = r"""\b[A-Za-z]:[\\/]{1,2}(?:[^\\/:*?"<>|\s]+(?: [^\\/:*?"<>|\s]+)*[\\/]{1,2})*[^\\/:*?"<>|\s]*"""
UNIX_PATH = r"(?:~|\$HOME)(?:/[\w.@%+\-~]+)+/?|(?:/[\w.@%+\-~]+){2,}/?"
INTERNAL_HOST = r"(?i)\b(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.){2,}(?:internal|intranet|intra|corp|local|lan|localdomain)\b"
HOME_PATH = r"(?:/Users/|/home/|\b[A-Za-z]:(?:\\{1,2}|/)Users(?:\\{1,2}|/))"
ACCOUNT = r"[A-Za-z0-9._\-]+"
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
EMAIL_LIKE = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
IPV4 = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"
TOKEN_RUN = r"[A-Za-z0-9_\-]+"

KEYWORDS = {
    "PERSON": "name named called mr mrs ms dr prof author patient client employee contact person user owner recipient sender".split(),
    "EMAIL": "email e-mail mail contact send write reach address".split(),
    "PHONE": "phone call tel telephone mobile cell fax number dial reach".split(),
    "LOCATION": "address street city state country zip postal live lives located from born based".split(),
    "ADDRESS": "address street st road rd avenue ave lane ln zip postal".split(),
    "URL": "url link website web site homepage profile".split(),
    "FILE_PATH": "path file folder directory dir saved mappa fájl könyvtár".split(),
    "USERNAME": "username user handle login account profile".split(),
    "PASSWORD": "password passcode secret credential token".split(),
    "SSN": "ssn social security tax identification id".split(),
    "CREDIT_CARD": "card credit debit visa mastercard amex payment cc".split(),
    "IBAN": "iban bank account transfer wire routing".split(),
    "BANK_ACCOUNT": "bank account routing transfer wire swift bic".split(),
    "DATE": "born birthday dob date birth issued expires expiry".split(),
}

#: Least score of a model's span.
MODEL_MINIMUM = {
    "PERSON": 0.55, "LOCATION": 0.55, "ADDRESS": 0.55, "ORGANIZATION": 0.50, "URL": 0.60, "USERNAME": 0.60, "PASSWORD": 0.60,
    "BANK_ACCOUNT": 0.50, "EMAIL": 0.80, "PHONE": 0.80, "CREDIT_CARD": 0.80, "SSN": 0.80, "IBAN": 0.80, "IP_ADDRESS": 0.80,
    "DATE": 0.80, "SECRET": 0.80, "HOSTNAME": 0.80, "FILE_PATH": 0.80, "IDENTIFIER": 0.80, "MISC": 0.70,
}

#: Threshold at the slider's middle, and how far the slider moves it.
SENSITIVITY = {
    "PASSWORD": (0.70, 0.05), "SECRET": (0.70, 0.05), "CREDIT_CARD": (0.50, 0.15), "SSN": (0.50, 0.15), "IBAN": (0.50, 0.15),
    "BANK_ACCOUNT": (0.50, 0.15), "EMAIL": (0.40, 0.20), "PHONE": (0.40, 0.20), "ADDRESS": (0.50, 0.20), "PERSON": (0.50, 0.20),
    "USERNAME": (0.50, 0.20), "IP_ADDRESS": (0.50, 0.20), "HOSTNAME": (0.50, 0.20), "FILE_PATH": (0.50, 0.20),
    "IDENTIFIER": (0.50, 0.20), "LOCATION": (0.50, 0.20), "ORGANIZATION": (0.50, 0.20), "URL": (0.50, 0.30), "DATE": (0.40, 0.30), "MISC": (0.50, 0.20),
}

GROUPS = {
    "Identity": ("PERSON", "USERNAME"),
    "Contact": ("EMAIL", "PHONE", "ADDRESS"),
    "Financial": ("CREDIT_CARD", "IBAN", "BANK_ACCOUNT", "SSN"),
    "Network": ("IP_ADDRESS", "HOSTNAME", "URL", "FILE_PATH"),
    "Location": ("LOCATION",),
    "Password": ("PASSWORD", "SECRET"),
    "Organization": ("ORGANIZATION",),
    "Low-signal": ("DATE", "MISC"),
}
GROUPS_OFF = ("Low-signal",)
GROUP_OF = {t: g for g, ts in GROUPS.items() for t in ts}

#: Types whose pattern spans outrank others where they overlap.
STRUCTURED = ("CREDIT_CARD", "IBAN", "SSN", "EMAIL", "PHONE", "IP_ADDRESS", "DATE", "SECRET", "URL", "FILE_PATH", "PASSWORD")

PRIVATE_SUFFIXES = "internal intranet intra corp local lan localdomain home private".split()
TENANT_DOMAINS = (
    "sharepoint.com atlassian.net slack.com zendesk.com my.salesforce.com lightning.force.com service-now.com okta.com webex.com zoom.us "
    "freshdesk.com notion.site myworkday.com bamboohr.com gitlab.io"
).split()
DOCUMENT_DOMAINS = (
    "docs.google.com drive.google.com meet.google.com forms.gle dropbox.com 1drv.ms onedrive.live.com notion.so figma.com box.com wetransfer.com "
    "we.tl teams.microsoft.com teams.live.com zoom.us calendly.com trello.com miro.com airtable.com"
).split()
PROFILE_DOMAINS = "facebook.com instagram.com x.com twitter.com tiktok.com threads.net t.me wa.me".split()
PUBLIC_DOMAINS = (
    "wikipedia.org wikimedia.org wiktionary.org wikidata.org github.com githubusercontent.com gitlab.com bitbucket.org stackoverflow.com "
    "stackexchange.com superuser.com serverfault.com askubuntu.com mozilla.org python.org pypi.org npmjs.com crates.io docs.rs rust-lang.org go.dev "
    "golang.org nodejs.org microsoft.com apple.com google.com youtube.com youtu.be w3.org w3schools.com readthedocs.io readthedocs.org arxiv.org doi.org "
    "ietf.org rfc-editor.org kernel.org debian.org ubuntu.com archlinux.org docker.com kubernetes.io amazon.com cloudflare.com jsdelivr.net unpkg.com "
    "apache.org gnu.org oracle.com jetbrains.com visualstudio.com typescriptlang.org react.dev reactjs.org vuejs.org angular.dev angular.io svelte.dev "
    "nextjs.org php.net cppreference.com nuget.org rubygems.org mvnrepository.com openai.com anthropic.com reddit.com medium.com dev.to linkedin.com "
    "facebook.com instagram.com x.com twitter.com tiktok.com example.com example.org example.net localhost gov gov.uk gov.hu europa.eu int"
).split()
SITE_PAGES = (
    "home explore search help about login signup settings hashtag i intent share sharer sharer.php policies legal privacy terms tos watch groups events "
    "pages marketplace reel reels p tv"
).split()
SENSITIVE_KEYS = "key sig sid code user username uid userid user_id account phone pwd pass ssn otp state".split()
SENSITIVE_KEY_PARTS = "token secret signature password passwd session auth apikey api_key credential email".split()
SHARED_HOMES = ["shared", "public", "default", "guest", "user", "username", "all users", "default user"]

#: Synthetic values, by type; cycled.
POOLS = {
    "PERSON": [
        "Jordan Park", "Casey Morrow", "Avery Quinn", "Riley Bennett", "Morgan Sato", "Sage Carrillo", "Quinn Holloway", "Reese Aldana", "Hayden Pereira", "Devon Tatsumi", "Emery Coleman", "Skyler Bishop",
        "Rowan Esposito", "Cameron Liu", "Drew Whitfield", "Logan Marquez", "Phoenix Andrade", "Tatum Okafor", "Noor Aldridge", "Aspen Fontaine", "Indigo Ramos", "Wren Sutherland", "Ellis Vargas", "Frankie Bowen",
    ],
    "LOCATION": [
        "Springwood", "Bridgewater", "Northvale", "Cedar Hollow", "Westmoor", "Stonebrook", "Fairhaven", "Riverbend", "Hillcrest", "Oakridge", "Pinewell", "Brookline Park", "Lakeshore", "Foxglen", "Maple Heights", "Silverpoint",
    ],
    "ORGANIZATION": [
        "Quantum Ridge Industries", "Atlas Group", "Midwest Holdings", "Northstar Solutions", "Cobalt Logistics", "Vertex Manufacturing", "Greenline Partners", "Harborwave Capital",
        "Ironcrest Software", "Silverthorn Media", "Pinepoint Research", "Brightwater Systems", "Cedarpath Consulting", "Lumiscope Labs", "Foxhaven Enterprises", "Riftgate Holdings",
    ],
    "ADDRESS": [
        "742 Evergreen Ln", "1521 Maple Ave", "38 Foxglove Rd", "904 Cedar Hollow Dr", "227 Westmoor Ct", "610 Hawthorn St", "1843 Brookline Way", "76 Pineapple Ridge", "350 Aurora Pkwy", "1109 Linden Cir", "85 Birchcrest Ter", "6204 Silverpoint Ave",
    ],
    "USERNAME": ["parkour_jordan", "casey_dev", "avery_2025", "riley_writes", "morgan_codes", "sage_says", "quinn_q", "reese_reader", "hayden_makes", "devon_dev"],
    "MISC": ["Project Bluebird", "Initiative Echo", "Item Falcon", "Reference Spruce", "Codename Lantern", "Token Mariner"],
    "PHONE": ["+1 (555) 010-0123", "+1 (555) 010-0145", "+1 (555) 010-0167", "+1 (555) 010-0189", "+1 (555) 010-0211", "+1 (555) 010-0233"],
    "CREDIT_CARD": ["4111 1111 1111 1111", "5555 5555 5555 4444", "3782 822463 10005", "6011 1111 1111 1117"],
    "SSN": ["900-92-0001", "900-92-0042", "900-92-0117", "900-92-0234", "900-92-0367"],
    "IBAN": ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606"],
    "IP_ADDRESS": ["192.0.2.10", "192.0.2.42", "198.51.100.7", "198.51.100.55", "203.0.113.21", "203.0.113.99"],
    "BANK_ACCOUNT": ["9999 0001 2345 6701", "9999 0001 9876 5432", "9999 0002 1357 9024"],
}
EMAIL_DOMAINS = ["example.com", "example.org", "example.net"]

#: Entities that stand in for a model's: text, type, score.
GAZETTEER = (
    ("Ada Lovelace", "PERSON", 0.92), ("David Smith", "PERSON", 0.92), ("Anna Müller", "PERSON", 0.92), ("Acme Corp", "ORGANIZATION", 0.90), ("Beispiel GmbH", "ORGANIZATION", 0.90), ("Berlin", "LOCATION", 0.88),
    ("München", "LOCATION", 0.88), ("42 Cedar St", "ADDRESS", 0.91), ("https://portal.example/private", "URL", 0.94), ("alice_admin", "USERNAME", 0.89), ("correct-horse", "PASSWORD", 0.87), ("1234567890", "BANK_ACCOUNT", 0.86),
)

#: Labels of three kinds of models: type -> labels, as normalized.
MODEL_LABELS = {
    "general": {
        "PERSON": "PER PERSON NAME FULL_NAME FIRSTNAME FIRST_NAME GIVEN_NAME LASTNAME LAST_NAME FAMILY_NAME MIDDLENAME MIDDLE_NAME",
        "ORGANIZATION": "ORG ORGANIZATION ORGANISATION COMPANY COMPANY_NAME COMPANYNAME BUSINESS",
        "LOCATION": "LOC LOCATION GPE CITY COUNTRY STATE COUNTY REGION",
        "ADDRESS": "ADDRESS STREET STREET_ADDRESS STREETADDRESS POSTAL_ADDRESS POSTCODE POSTAL_CODE ZIP ZIPCODE ZIP_CODE",
        "URL": "URL URI WEBSITE WEB_URL",
        "USERNAME": "USERNAME USER_NAME HANDLE LOGIN",
        "PASSWORD": "PASSWORD PASSWD PASSCODE PIN",
        "BANK_ACCOUNT": "BANK_ACCOUNT BANKACCOUNT ACCOUNT_NUMBER ACCOUNTNUMBER BANK_ACCOUNT_NUMBER",
        "EMAIL": "EMAIL EMAIL_ADDRESS MAIL",
        "PHONE": "PHONE PHONE_NUMBER PHONENUMBER TELEPHONE MOBILE",
        "CREDIT_CARD": "CREDIT_CARD CREDITCARD CREDIT_CARD_NUMBER CREDITCARDNUMBER",
        "SSN": "SSN SOCIAL_SECURITY_NUMBER SOCIALSECURITYNUMBER",
        "IBAN": "IBAN IBAN_CODE",
        "IP_ADDRESS": "IP IP_ADDRESS IPV4 IPV6",
        "DATE": "DATE DOB DATE_OF_BIRTH BIRTHDATE",
        "MISC": "MISC PASSPORT PASSPORT_NUMBER DRIVER_LICENSE DRIVERS_LICENSE NATIONAL_ID ID_CARD",
    },
    "sensitive": {
        "USERNAME": "ACCOUNT_IDENTIFIER CONTACT_HANDLE",
        "PASSWORD": "AUTH_SECRET",
        "BANK_ACCOUNT": "BANK_ACCOUNT_IDENTIFIER",
        "MISC": (
            "BIOMETRIC_DATA CRIMINAL_OFFENCE_DATA DEVICE_IDENTIFIER DOCUMENT_IDENTIFIER DOCUMENT_REFERENCE ETHNIC_ORIGIN FINANCIAL_AMOUNT HEALTH_DATA PERSON_ATTRIBUTE PERSON_IDENTIFIER PERSON_ROLE_OR_TITLE "
            "POLITICAL_OPINION PROPER_NAME RELIGION_OR_BELIEF SEXUAL_ORIENTATION TRADE_UNION_MEMBERSHIP VEHICLE_IDENTIFIER"
        ),
        "DATE": "DATE_OF_BIRTH",
        "EMAIL": "EMAIL_ADDRESS",
        "LOCATION": "GEO_LOCATION LOCATION",
        "URL": "IDENTIFYING_LINK",
        "IP_ADDRESS": "IP_ADDRESS",
        "ORGANIZATION": "ORGANIZATION_IDENTIFIER ORGANIZATION_NAME",
        "CREDIT_CARD": "PAYMENT_CARD PAYMENT_CARD_SECURITY",
        "PERSON": "PERSON_ALIAS PERSON_NAME",
        "PHONE": "PHONE_NUMBER",
        "ADDRESS": "POSTAL_ADDRESS",
    },
    "compact": {
        "PERSON": "GIVENNAME SURNAME", "DATE": "DATEOFBIRTH", "USERNAME": "USERNAME", "PASSWORD": "PASSWORD", "EMAIL": "EMAIL", "PHONE": "TELEPHONENUM", "ADDRESS": "STREET BUILDINGNUM ZIPCODE", "LOCATION": "CITY",
        "CREDIT_CARD": "CREDITCARDNUMBER", "BANK_ACCOUNT": "ACCOUNTNUM", "SSN": "SOCIALNUM", "MISC": "TAXNUM DRIVERLICENSENUM IDCARDNUM",
    },
}
#: Least scores of a model's spans before they are passed on; where a kind differs from MODEL_MINIMUM.
MODEL_GATE = {"general": {"MISC": 0.90}, "sensitive": {"MISC": 0.70}, "compact": {"MISC": 0.90}}
