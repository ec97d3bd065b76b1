"""Phrase lists of the wording statistics."""

# A message counts when it contains any phrase of the list as a substring.
COMPLIMENT = (
    "amazing", "beautiful", "brilliant", "charming", "classy", "cool", "cute", "elegant",
    "fantastic", "fascinating", "gorgeous", "graceful", "handsome", "impressive", "incredible",
    "intelligent", "kind", "lovely", "marvelous", "nice", "outstanding", "phenomenal",
    "remarkable", "spectacular", "stunning", "superb", "sweet", "talented", "terrific",
    "thoughtful", "unique", "wonderful", "adorable", "genius", "radiant", "smart", "strong",
    "wise", "excellent", "fabulous", "brilliant", "perfect", "flawless", "dashing", "glorious",
    "breathtaking", "divine", "ravishing", "magnificent",
)

# As above, for apologies.
APOLOGY = (
    "sorry", "apologize", "forgive", "pardon", "regret", "mistake", "oops", "remorse", "ashamed",
    "guilt", "blunder", "sorryyy", "maaf", "shama", "galti", "my bad",
)

# As above, for questions.
QUESTIONING = (
    "who", "what", "when", "where", "why", "how", "which", "whom", "whose", "is", "are", "do",
    "does", "can", "could", "should", "was", "have", "kya", "kaun", "kab", "kyu", "kaise",
    "kitna", "kahan",
)

# As above, for swearing.
SWEARING = (
    "fuck", "shit", "bitch", "asshole", "ass", "bastard", "damn", "crap", "hell", "dick", "prick",
    "cunt", "gaandu", "bhenchod", "madarchod", "chutiya", "harami", "kutti", "lodu", "loda",
    "ullu", "kutta", "suar", "bakchod", "mc", "bc", "choot", "chodu", "jhantu", "randi", "bhadwa",
    "lannat", "haraami", "kameena", "behen ke lode", "teri maa ki", "gadha", "bhosdi", "lawda",
    "rakhail", "chaman", "nalayak", "tatti", "launde", "tharki", "haraamkhor", "gandu", "lauda",
    "bhikari", "charsi", "nashadi", "lukkha", "bewakoof", "kamchor", "paagal", "chor", "bhadwe",
    "gawar", "kanjar", "teri behan ki", "teri maa ka", "g**nd", "bkl", "bc", "mc",
    "teri maa ki chut", "bhosdike", "chut ke pasine", "lodu", "chodu", "bhosdika", "gaand mara",
    "chinal", "hawas ka pujari", "kamina", "chudai", "chudail", "halkat", "chikna", "chikni",
    "phattu", "randwa", "fuddu", "chaman", "madarchod", "bhen ke lode", "suar ka bacha",
    "teri gaand", "kutte", "billi ka bacha", "chodu saala", "jhantu", "cunt", "motherfucker",
    "pussy", "bastard", "son of a bitch", "asshat", "shithead", "dumbass", "retard", "moron",
    "dipshit", "wanker", "twat", "tosser", "cockhead", "fuckwit", "shitbag", "douchebag",
    "arsehole", "bollocks", "bugger", "knobhead", "piss off", "twatwaffle", "minge", "pillock",
    "bellend", "gobshite", "dickweed", "shitface", "arse", "bloody hell",
)

PHRASES = {
    "apology": APOLOGY,
    "compliment": COMPLIMENT,
    "questioning": QUESTIONING,
    "swearing": SWEARING,
}

# A short dictionary for tests; real ones are read by sources.dictionaries.
# "a.m" shows a key that can never match, because tokens lose their punctuation before lookup.
ABBREVIATIONS = {
    "a.m": "before midday",
    "app": "application",
    "asap": "as soon as possible",
    "b4": "before",
    "brb": "be right back",
    "btw": "by the way",
    "fyi": "for your information",
    "gn": "good night",
    "gr8": "great",
    "idk": "i do not know",
    "imo": "in my opinion",
    "lol": "laughing out loud",
    "omg": "oh my god",
    "omw": "on my way",
    "pls": "please",
    "tbh": "to be honest",
    "thx": "thank you",
    "ttyl": "talk to you later",
    "u": "you",
    "w8": "wait",
}
