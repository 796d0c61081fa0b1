"""Pattern families, reasons and templates.  All are parameters of the operators; these are defaults."""

from __future__ import annotations

#: Families for the stored tables, first match wins.
FAMILIES = {
    "licence": "licensed|licence|license|rights reserved",
    "insult": "idiot|moron|clown|trash",
    "english": "the|and|with",
    "romance": "que|los|les|des",
    "german": "der|und|die",
}
PII = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|[0-9][0-9 \-]{11,}[0-9]"

# The keyword families of support messages that results depend on, in matching order.
MUST = {
    "account_access": r"can.?t (?:log|sign) ?in|locked out|hacked|account (?:is )?(?:locked|disabled|suspended|compromis)|password|reset my account",
    "payment_dispute": r"charged (?:me )?(?:twice|again)|double charg|unauthoriz|didn.?t authorize|refund|money back|fraudulent|wrong(?:ly)? charg|cancel my (?:subscription|premium)|still being charged",
    "security_privacy": r"hacked|phish|scam|fraud|stolen|breach|identity",
    "legal_rights": r"lawyer|legal|sue|lawsuit|attorney|gdpr|ombudsman|regulator",
    "safety": r"threat|assault|unsafe|emergency|medical|discriminat|racist|harass",
}
TOPICS = {
    "money/refund": r"refund|charge|charged|billing|bill|payment|paid|invoice|subscription|premium|money|price|overcharg",
    "account/login": r"account|login|log in|password|sign in|signin|username|locked|hacked|verify|verification",
    "technical/bug": r"not work|doesn.?t work|broken|bug|crash|error|glitch|won.?t (?:play|load|open)|freez|stuck|offline",
    "anger/profanity": r"fuck|shit|wtf|useless|garbage|terrible|awful|worst|disgust|ridiculous|furious|angry|pissed",
    "praise": r"thank you|thanks|thx|love you|awesome|amazing|great job|appreciate|best",
    "delay/cancel": r"delay|delayed|cancel|cancelled|canceled|rebook|missed (?:my )?(?:flight|connection)|stranded",
    "baggage": r"bag|bags|baggage|luggage|suitcase|carry.?on|checked bag",
}
SEEDS = {
    "account_access": r"can.?t (?:log|sign) ?in|cant (?:log|sign) ?in|log ?in|login|sign ?in|password|hacked|locked out|account (?:is )?(?:locked|disabled|suspended|hijack|compromis)|someone (?:else )?(?:is us|has|used) my|recover my account|verify my account",
    "billing_subscription": r"charged|charge|charging|refund|money back|payment (?:failed|declined|issue)|billed|billing|invoice|double charg|cancel (?:my )?(?:premium|subscription)|unsubscrib|still (?:being )?charg",
    "plans_eligibility": r"family plan|premium family|student (?:discount|plan|verif)|duo|upgrade to premium|free trial|promo|offer|discount|eligib|how much (?:is|does)|price|switch (?:to|my) plan|join (?:the )?family",
    "content_availability": r"not available|isn.?t available|unavailable|available in|not (?:on|in) {brand}|missing from|removed|take[n]? off|why (?:isn.?t|is|aren.?t|are).{0,30}(?:on {brand}|available)|release|new album|when will .{0,20}be (?:on|available)",
    "product_feature_feedback": r"please add|add (?:an? )?(?:option|feature|button)|would (?:love|be nice|be great)|wish (?:you|there|{brand})|suggestion|feature request|bring back|why can.?t (?:i|we|you)|needs? an? (?:option|feature|way)|option to|there (?:should|needs to) be|make it (?:possible|so)|hope you (?:add|fix)",
    "app_device_technical": r"app (?:crash|keeps|won.?t|is|not)|crash|crashing|update the app|latest version|ios|android|apple watch|windows|web player|desktop app|chromecast|alexa|google home|car ?play|bluetooth|battery|connect to",
    "playback_playlist": r"playlist|shuffle|skip|queue|offline|download(?:ed|ing)?|repeat|won.?t play|not play|stops? playing|keeps? pausing|song(?:s)? play|listen",
}
INTENT_PROXY = {
    "billing_subscription": r"premium|subscription|billing|charged|payment|family plan|student",
    "content_availability": r"album|song|artist|podcast|episode|available|release|missing from",
    "playback_technical": r"won.?t play|not play|skip|offline|download|shuffle|crash|buffer|glitch",
    "praise_social": r"thank|thanks|love|awesome|amazing|appreciate|best",
    "delay_cancel": r"delay|cancel|rebook|missed (?:my )?(?:flight|connection)|stranded|diverted",
    "baggage": r"bag|baggage|luggage|suitcase|carry.?on",
    "seat_booking": r"seat|upgrade|boarding pass|check.?in|reservation|record locator|booking",
    "loyalty": r"miles|aadvantage|loyalty|status|elite|points",
}
PERSONAL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|\d[\d \-]{11,}\d|(?:my|the) (?:email|e-mail|address|phone|number) is"
FOLLOW_UP = r"dm(?:'?d| sent| you)|sent (?:you )?a dm|check your dm|answer my dm"
SELF_SERVICE = (
    r"tried everything|already tried|i.?ve tried|tried (?:that|this|it) (?:already|too)|still (?:not|isn.?t|doesn.?t|won.?t|no)|reinstall|re-?installed|restarted|rebooted"
    r"|uninstall|no (?:one|body) (?:has )?(?:replied|responded|answered)|no response|third time|3rd time|second time|2nd time|weeks? (?:now|and)|no luck|nothing works"
)
OUT_OF_SCOPE = (
    r"upload (?:my|our|his|her|their|the) (?:music|song|album|track)|{brand} for artists|distribut(?:e|ion|or)|get (?:my|our) (?:music|songs) on"
    r"|submit (?:my|our) (?:music|song|album)|as an artist"
)
SUPPORT_FALLBACK = {"account_access": "account_access", "billing_subscription": "payment_dispute", "other_unclear": "ambiguous"}
REASONS = ("account_access", "ambiguous", "existing_case", "failed_self_service", "high_frustration", "legal_rights", "out_of_scope", "payment_dispute", "public_pii", "safety_abuse", "security")
# End of fixed values.

#: Rules that give a reason, in order, over the stored tables.
REASON_RULES = {"public_pii": "licensed|license", "high_frustration": "idiot|moron|clown|trash", "existing_case": "und|der", "failed_self_service": "que"}
INTENT_FALLBACK = {"english": "account_access", "romance": "payment_dispute"}
ROLES = {"licence": "independent", "insult": "independent", "english": "none", "romance": "conditional", "german": "none"}
MUST_FAMILIES = ("licence", "insult")


def seeds(brand: str) -> dict[str, str]:
    """The intent families of support messages, in matching order, for a brand's own name."""
    return {name: pattern.replace("{brand}", brand) for name, pattern in SEEDS.items()}


def support_rules(brand: str) -> dict[str, str]:
    """The ten rules that give a reason to hand a support message over, in order: exposure and safety before convenience."""
    return {
        "public_pii": PERSONAL, "safety_abuse": MUST["safety"], "legal_rights": MUST["legal_rights"], "security": MUST["security_privacy"], "payment_dispute": MUST["payment_dispute"],
        "account_access": MUST["account_access"], "existing_case": FOLLOW_UP, "failed_self_service": SELF_SERVICE, "high_frustration": TOPICS["anger/profanity"], "out_of_scope": OUT_OF_SCOPE.replace("{brand}", brand),
    }


#: Requests that stored messages are given, so that the support families have something to find.
REQUESTS = (
    "I can't sign in since Monday and the password mail never comes", "you charged me twice, I want my money back", "my email is pat.doe@example.org, write to me", "my lawyer will hear of this", "the driver made a threat",
    "someone hacked the thing", "I sent you a dm an hour ago", "I already tried that, still not working", "this is ridiculous and useless", "how do I get my songs on acme", "is there a student discount",
    "please add a sleep timer", "the app keeps crashing on android", "my playlist won't shuffle", "why is the new album not available", "thanks, you are the best", "they lost my bag and my flight is delayed", "card 4111 1111 1111 1111 was used", "hello",
)


def template(reason: str) -> str:
    """A fixed handoff text for a reason; it promises nothing and takes nothing from the message."""
    return f"Thanks for writing. This concerns {reason.replace('_', ' ')}, so please send us a private message and our team will follow up there."
