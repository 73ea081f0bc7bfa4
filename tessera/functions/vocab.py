"""Dictionaries and word lists that results depend on."""

# fixed values: words of Indian scripts and their Latin forms
INDIC_WORDS = {
    "यूनिवर्सल": "universal", "इम्पेक्स": "impex", "प्राइवेट": "private", "लिमिटेड": "limited", "शिवम": "shivam", "फूड्स": "foods",
    "स्पाइसेज": "spices", "एंड": "and", "सदर्न": "southern", "इंफोटेक": "infotech", "फॉर्च्यून": "fortune", "मार्केटिंग": "marketing",
    "ग्रेट": "great", "प्रोजेक्ट्स": "projects", "भारत": "bharat", "इलेक्ट्रॉनिक्स": "electronics", "इलेक्ट्रिकल": "electricals", "गणेश": "ganesh",
    "ट्रेडिंग": "trading", "एसोसिएट्स": "associates", "महाराजा": "maharaja", "टेक्सटाइल्स": "textiles", "एक्सपोर्ट्स": "exports", "कृष्णा": "krishna",
    "इंजीनियरिंग": "engineering", "वर्क्स": "works", "रिलायंस": "reliance", "ग्लोबल": "global", "वेंचर्स": "ventures", "एंटरप्राइजेज": "enterprises",
    "सोल्यूशंस": "solutions", "इंडस्ट्रीज": "industries", "टेक्नोलॉजीज": "technologies", "इंटरनेशनल": "international", "सर्विसेज": "services",
    "ट्रेडर्स": "traders", "कॉर्पोरेशन": "corporation", "लॉजिस्टिक्स": "logistics", "फार्मा": "pharma", "केमिकल्स": "chemicals", "हॉस्पिटैलिटी": "hospitality",
    "ટેક": "tech", "માર્કેટિંગ": "marketing", "લિમિટેડ": "limited", "ઇમ્પેક્સ": "impex", "પ્રાઇવેટ": "private",
    "ਫਾਰਚੂਨ": "fortune", "ਫੂਡਜ਼": "foods",
}

# fixed values: words of the smaller dictionary of the studio dialect
STUDIO_INDIC_WORDS = (
    "यूनिवर्सल इम्पेक्स प्राइवेट लिमिटेड शिवम फूड्स सदर्न इंफोटेक ટેક માર્કેટિંગ લિમિટેડ ग्रेट प्रोजेक्ट्स ਫਾਰਚੂਨ ਫੂਡਜ਼ एंटरप्राइजेज सोल्यूशंस इंडस्ट्रीज "
    "टेक्नोलॉजीज ग्लोबल इंटरनेशनल सर्विसेज ट्रेडर्स कॉर्पोरेशन लॉजिस्टिक्स फार्मा केमिकल्स इंजीनियरिंग एसोसिएट्स हॉस्पिटैलिटी इलेक्ट्रॉनिक्स"
).split()

# fixed values: Devanagari consonants and vowels in Latin; an empty value drops the sign
DEVANAGARI_CONSONANTS = {
    0x0915: "k", 0x0916: "kh", 0x0917: "g", 0x0918: "gh", 0x0919: "ng", 0x091A: "ch", 0x091B: "chh", 0x091C: "j", 0x091D: "jh", 0x091E: "ny",
    0x091F: "t", 0x0920: "th", 0x0921: "d", 0x0922: "dh", 0x0923: "n", 0x0924: "t", 0x0925: "th", 0x0926: "d", 0x0927: "dh", 0x0928: "n",
    0x092A: "p", 0x092B: "ph", 0x092C: "b", 0x092D: "bh", 0x092E: "m", 0x092F: "y", 0x0930: "r", 0x0932: "l", 0x0935: "v", 0x0936: "sh",
    0x0937: "sh", 0x0938: "s", 0x0939: "h", 0x0958: "q", 0x0959: "kh", 0x095A: "g", 0x095B: "z", 0x095C: "r", 0x095D: "rh", 0x095E: "f",
}
DEVANAGARI_VOWELS = {
    0x0905: "a", 0x0906: "a", 0x0907: "i", 0x0908: "i", 0x0909: "u", 0x090A: "u", 0x090F: "e", 0x0910: "ai", 0x0913: "o", 0x0914: "au",
    0x093E: "a", 0x093F: "i", 0x0940: "i", 0x0941: "u", 0x0942: "u", 0x0947: "e", 0x0948: "ai", 0x094B: "o", 0x094C: "au", 0x094D: "",
}

# fixed values: letters that sound alike, and digits written for letters (from, to)
SOUND_ALIKE = ("cqgzxdbw", "kkksstpv")
DIGIT_AS_LETTER = ("013457", "oleast")

# fixed values: words that a core name leaves out, by country
FREQUENT_WORDS = {
    "US": ("llc", "inc", "corp", "corporation", "co", "company", "ltd", "limited", "services", "enterprises"),
    "India": ("pvt", "ltd", "private", "limited", "enterprises", "trading", "company", "associates", "services"),
    "France": ("sarl", "sas", "sasu", "sa", "eurl", "sci", "france", "services", "societe", "cie"),
}

# fixed values: how likely a pair matches although this word differs
WORD_SCORES = {
    "services": 0.94, "service": 0.92, "dba": 0.98, "formerly": 0.97, "co": 0.89, "company": 0.91, "inc": 0.95, "incorporated": 0.95,
    "llc": 0.96, "corp": 0.94, "corporation": 0.93, "ltd": 0.96, "limited": 0.95, "pvt": 0.97, "private": 0.96, "enterprise": 0.88,
    "enterprises": 0.89, "group": 0.86, "solutions": 0.88, "tech": 0.87, "technologies": 0.88, "trading": 0.85, "international": 0.86,
    "global": 0.85, "industries": 0.87, "india": 0.89, "usa": 0.91, "france": 0.90, "sas": 0.97, "sarl": 0.96, "sa": 0.94, "eurl": 0.95,
    "midtown": 0.01, "uptown": 0.01, "downtown": 0.02, "south": 0.02, "north": 0.02, "east": 0.02, "west": 0.02, "central": 0.03,
    "airport": 0.01, "terminal": 0.01, "branch": 0.01, "annex": 0.02, "express": 0.04, "station": 0.02, "plaza": 0.03, "mall": 0.02,
    "outlet": 0.02, "subway": 0.01, "holdings": 0.04, "holding": 0.04, "properties": 0.03, "realty": 0.03, "capital": 0.04,
    "investments": 0.04, "sud": 0.02, "nord": 0.02, "est": 0.02, "ouest": 0.02, "gare": 0.01, "aeroport": 0.01,
}
NEUTRAL_SCORE = 0.5

# fixed values: words that tell a branch from its sibling, by dialect
SIBLING_WORDS = {
    "batch": (
        "midtown", "uptown", "downtown", "south", "north", "east", "west", "central", "airport", "terminal", "branch", "annex", "express",
        "station", "plaza", "mall", "outlet", "subway", "nord", "sud", "est", "ouest", "centre", "gare", "aeroport", "annexe",
    ),
    "studio": (
        "midtown", "uptown", "downtown", "south", "north", "east", "west", "central", "airport", "terminal", "branch", "annex", "express",
        "station", "plaza", "mall", "outlet", "subway",
    ),
    "evaluator": (
        "midtown", "uptown", "downtown", "south", "north", "east", "west", "central", "airport", "terminal", "branch", "annex", "express",
        "station", "plaza", "mall", "outlet", "subway", "nord", "sud", "est", "ouest", "gare", "aeroport",
    ),
}
