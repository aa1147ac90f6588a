"""Word lists and patterns: parameters with defaults, passed to the functions of this package."""

# Stop words, word endings, synonyms, parties, deliverables and patterns of the document domain.
STOP_WORDS = (
    "the a an and or but to of in on for with by from is are was were be been being this that these those it its as at into about "
    "what which who when where why how can could should would may might do does did"
).split()
STEM_ENDINGS = "ingly edly ments ment ness ations ation ions ion ities ity ies ied ing ers er ed es s".split()
SYNONYMS = {
    "definition": ["means", "defined", "definition", "refers", "interpretation"],
    "responsibility": ["responsible", "responsibility", "duties", "duty", "shall", "must", "obligation"],
    "requirement": ["required", "requirement", "shall", "must", "minimum", "mandatory"],
    "submit": ["submittal", "submit", "submission", "provide", "deliver"],
    "approve": ["approval", "approved", "acceptance", "accepted", "authorize", "authorized"],
    "inspect": ["inspection", "inspect", "verify", "verification", "review", "examine"],
    "schedule": ["scheduled", "scheduling", "timeline", "duration", "milestone", "completion"],
    "payment": ["pay", "paid", "compensation", "invoice", "billing", "reimbursement"],
    "contractor": ["vendor", "builder", "construction contractor", "prime contractor", "general contractor"],
    "owner": ["government", "va", "agency", "owner representative", "contracting officer", "cor"],
    "conflict": ["exception", "unless", "however", "notwithstanding", "supersede", "precedence", "discrepancy"],
    "closeout": ["turnover", "completion", "final acceptance", "punch list", "warranty", "record documents"],
    "safety": ["hazard", "protection", "unsafe", "incident", "osha", "life safety"],
}
PARTIES = [
    "contractor", "government", "owner", "owner qc", "owner representative", "resident engineer", "contracting officer", "co", "cor", "designer", "architect",
    "engineer", "commissioning agent", "oit", "subcontractor", "manufacturer", "vendor", "supplier", "fire marshal", "authority having jurisdiction", "ahj",
]
DELIVERABLES = [
    "submittal", "shop drawing", "product data", "sample", "inspection report", "test report", "commissioning report", "photograph", "certificate", "closeout",
    "record drawing", "as-built", "operation manual", "maintenance manual", "warranty", "training", "schedule", "mockup", "punch list",
]
TOKEN = r"[a-z0-9][a-z0-9._/-]*"
NEGATIVE = r"\b(shall not|must not|may not|is prohibited|are prohibited|not permitted)\b"
POSITIVE = r"\b(shall|must|required|is responsible for|will provide|will perform)\b"
REQUIREMENT = r"\b(shall|must|required|prohibited|may not|is responsible for|will provide|will perform)\b"
EXCEPTION = r"\b(exception|except|unless|however|notwithstanding|subject to|provided that)\b"
DEFINITION = r"\b(means|defined as|definition|refers to|shall mean)\b"
RESPONSIBILITY = r"\b(responsible for|responsibility|duties include|shall provide|shall perform|must provide|must perform)\b"
REQUIREMENT_NODE = r"\b(shall|must|required|prohibited|may)\b"
EXCEPTION_NODE = r"\b(unless|except|provided that|however|subject to|notwithstanding)\b"
ACCEPTANCE_NODE = r"\b(accepted when|approved by|successful completion|verified by|passes testing|acceptable|approval required|final acceptance)\b"
REFERENCES = [
    r"\b(?:section|article|chapter|appendix|specification|paragraph|part)\s+[a-z0-9][a-z0-9 ._-]*",
    r"\b\d{2}\s+\d{2}\s+\d{2}(?:\.\d+)*\b",
    r"\b\d+(?:\.\d+){1,5}\b",
]
INTENTS = {
    "definition": r"\b(define|definition|meaning|what is|what does .* mean)\b",
    "responsibility": r"\b(who|responsib|duty|duties|role|obligation)\b",
    "requirement": r"\b(require|required|requirement|shall|must|prohibit|mandatory)\b",
    "conflict": r"\b(exception|unless|conflict|precedence|supersede|contradict)\b",
    "submittal": r"\b(submit|submittal|provide for approval|submission)\b",
    "inspection": r"\b(inspect|inspection|verify|verification|review)\b",
    "schedule": r"\b(schedule|when|duration|timeline|milestone|completion date)\b",
    "payment": r"\b(payment|invoice|paid|compensation|billing)\b",
    "closeout": r"\b(closeout|turnover|final acceptance|warranty|punch list)\b",
    "dependency": r"\b(prerequisites?|predecessor|successor|dependenc(y|ies)|downstream|handoffs?)\b|\b(depends on|dependent on|required prior to)\b",
}
#: What a section must hold for an intent of the query to count, and its points.
INTENT_EVIDENCE = {
    "definition": (DEFINITION, 12.0),
    "responsibility": (RESPONSIBILITY, 12.0),
    "requirement": (REQUIREMENT, 10.0),
    "conflict": (EXCEPTION, 11.0),
    "submittal": (r"\b(submit|submittal|submission|provide for approval)\b", 9.0),
    "inspection": (r"\b(inspect|inspection|verify|verification|review)\b", 9.0),
    "schedule": (r"\b(schedule|scheduled|duration|timeline|milestone|completion)\b", 8.0),
    "payment": (r"\b(payment|invoice|billing|compensation|paid)\b", 8.0),
    "closeout": (r"\b(closeout|turnover|final acceptance|warranty|punch list|record documents)\b", 8.0),
}
TIMING = [
    r"\bprior to\b[^.;]*", r"\bbefore\b[^.;]*", r"\bafter\b[^.;]*",
    r"\bwithin\s+\d+\s+(?:calendar\s+|business\s+|working\s+)?(?:day|days|hour|hours|week|weeks|month|months)\b[^.;]*",
    r"\bnot later than\b[^.;]*", r"\bno later than\b[^.;]*", r"\bupon completion\b[^.;]*", r"\buntil\b[^.;]*", r"\bduring\b[^.;]*", r"\bwhen\b[^.;]*",
]
CONDITION = r"\b(?:if|when|where|provided that|subject to|unless|except when|after|before|upon)\b[^.;]*"
EXCEPTION_CLAUSE = r"\b(?:unless|except(?: when)?|provided that|however|subject to|notwithstanding)\b[^.;]*"
STRENGTH = {"prohibited": 100, "mandatory": 95, "permitted": 60, "advisory": 45, "informational": 25}
DELIVERABLE_TYPES = [
    ("submittal", r"\b(submittal|shop drawing|product data|sample|mockup)\b"), ("report", r"\b(report)\b"), ("certificate", r"\b(certificate|certification)\b"),
    ("schedule", r"\b(schedule)\b"), ("photograph", r"\b(photo|photograph)\b"), ("record-document", r"\b(record drawing|as-built)\b"), ("manual", r"\b(manual)\b"),
    ("warranty", r"\b(warranty)\b"), ("training", r"\b(training)\b"), ("closeout", r"\b(punch list|closeout)\b"),
]

# Actors, actions and marks of the clauses that assign work.
RESPONSIBLE_ACTORS = [
    ("owner_qc", r"\bowner(?:'s)?\s+(?:qa|qc|quality\s+(?:assurance|control)|inspector)\b"), ("cqc", r"\b(?:cqc|contractor(?:'s)?\s+quality\s+control|quality\s+control\s+manager)\b"),
    ("cor", r"\b(?:contracting\s+officer(?:'s)?\s+representative|cor)\b"), ("oit", r"\b(?:oit|office\s+of\s+information\s+(?:and\s+)?technology)\b"), ("ahj", r"\b(?:authority\s+having\s+jurisdiction|ahj)\b"),
    ("subcontractor", r"\b(?:subcontractor|sub-contractor|trade\s+contractor)\b"), ("contractor", r"\b(?:contractor|prime\s+contractor|general\s+contractor)\b"), ("government", r"\b(?:government|federal\s+government)\b"),
    ("va", r"\b(?:veterans\s+affairs|department\s+of\s+veterans\s+affairs|va)\b"), ("owner", r"\b(?:owner|owner's\s+representative)\b"), ("architect", r"\b(?:architect|a/e\s+architect)\b"),
    ("engineer", r"\b(?:engineer|a/e\s+engineer|engineer\s+of\s+record)\b"), ("designer", r"\b(?:designer|design\s+professional|a/e)\b"), ("manufacturer", r"\b(?:manufacturer|fabricator)\b"),
    ("vendor", r"\b(?:vendor|supplier)\b"), ("facility", r"\b(?:facility|medical\s+center|site\s+staff)\b"), ("third_party", r"\b(?:third[-\s]party|independent\s+testing\s+agency)\b"),
]
RESPONSIBLE_ACTIONS = [
    ("furnish", r"\b(?:furnish(?:es|ed|ing)?|owner[-\s]furnished)\b"), ("install", r"\binstall(?:s|ed|ing|ation)?\b"), ("provide", r"\bprovide(?:s|d|ing)?\b"), ("supply", r"\b(?:supply|supplies|supplied|supplying)\b"),
    ("approve", r"\bapprove(?:s|d|ing|al)?\b"), ("review", r"\breview(?:s|ed|ing)?\b"), ("inspect", r"\binspect(?:s|ed|ing|ion)?\b"), ("verify", r"\bverif(?:y|ies|ied|ication)\b"), ("test", r"\btest(?:s|ed|ing)?\b"),
    ("submit", r"\b(?:submit(?:s|ted|ting)?|submission)\b"), ("coordinate", r"\bcoordinat(?:e|es|ed|ing|ion)\b"), ("schedule", r"\bschedul(?:e|es|ed|ing)\b"), ("notify", r"\bnotif(?:y|ies|ied|ication)\b"),
    ("maintain", r"\b(?:maintain(?:s|ed|ing)?|maintenance)\b"), ("remove", r"\bremov(?:e|es|ed|ing|al)\b"), ("replace", r"\breplac(?:e|es|ed|ing|ement)\b"), ("protect", r"\bprotect(?:s|ed|ing|ion)?\b"),
    ("restore", r"\brestor(?:e|es|ed|ing|ation)\b"), ("accept", r"\baccept(?:s|ed|ing|ance)?\b"), ("authorize", r"\bauthoriz(?:e|es|ed|ing|ation)\b"), ("document", r"\bdocument(?:s|ed|ing|ation)?\b"),
    ("perform", r"\bperform(?:s|ed|ing|ance)?\b"), ("complete", r"\bcomplet(?:e|es|ed|ing|ion)\b"), ("correct", r"\bcorrect(?:s|ed|ing|ion)?\b"),
]
RESPONSIBLE_NEGATION = r"\b(?:shall\s+not|must\s+not|is\s+not\s+responsible|not\s+responsible|excluding|except\s+for)\b"
RESPONSIBLE_EXCLUSIVE = r"\b(?:solely\s+responsible|exclusive(?:ly)?\s+responsible|shall\s+be\s+the\s+responsibility\s+of|only\s+the|no\s+other\s+party)\b"
RESPONSIBLE_BINDING = r"\b(?:shall|must|is\s+responsible)\b"
CLAUSE_MODAL = r"\b(?:shall|must|will|should|may|required|is\s+responsible|are\s+responsible)\b"
CLAUSE_QUALIFIER = r"\b(?:provided|except|unless|subject\s+to|in\s+accordance\s+with)\b"
CLAUSE_CONDITION = r"\b(?:if|when|where|before|after|until|upon|within|prior\s+to|provided\s+that|subject\s+to|unless|except)\b[^.;:\n]*"
OBJECT_ARTICLE = r"\b(?:the|all|any)\b\s*"

# What makes a text an acceptance criterion.
ACCEPTANCE_ACTIONS = [
    ("accept", r"\baccept(?:s|ed|ing|ance)?\b"), ("approve", r"\bapprov(?:e|es|ed|ing|al)\b"), ("verify", r"\bverif(?:y|ies|ied|ication)\b"), ("inspect", r"\binspect(?:s|ed|ing|ion)?\b"), ("test", r"\btest(?:s|ed|ing)?\b"),
    ("certify", r"\bcertif(?:y|ies|ied|ication)\b"), ("witness", r"\bwitness(?:es|ed|ing)?\b"), ("sign_off", r"\bsign[-\s]?off\b|\bsigned\s+off\b"), ("complete", r"\bcomplet(?:e|es|ed|ing|ion)\b"), ("close", r"\bclos(?:e|es|ed|ing|ure)\b"),
    ("release", r"\breleas(?:e|es|ed|ing)\b"), ("commission", r"\bcommission(?:s|ed|ing)?\b"), ("authorize", r"\bauthoriz(?:e|es|ed|ing|ation)\b"), ("validate", r"\bvalidat(?:e|es|ed|ing|ion)\b"), ("document", r"\bdocument(?:s|ed|ing|ation)?\b"),
]
ACCEPTANCE_STATUS = [
    ("prohibited", r"\bshall\s+not\b|\bmust\s+not\b|\bnot\s+acceptable\b"), ("conditional", r"\bif\b|\bwhen\b|\bprovided\s+that\b|\bsubject\s+to\b|\bafter\b|\bupon\b"),
    ("optional", r"\bmay\b|\boptional\b|\bat\s+the\s+discretion\b"), ("required", r"\bshall\b|\bmust\b|\brequired\b|\bis\s+to\s+be\b"),
]
ACCEPTANCE_EVIDENCE = [
    ("test report", r"\btest\s+report\b"), ("inspection report", r"\binspection\s+report\b"), ("certificate", r"\bcertificate\b"), ("certification", r"\bcertification\b"), ("commissioning report", r"\bcommissioning\s+report\b"),
    ("photograph", r"\bphotograph(?:s|ic)?\b"), ("photo documentation", r"\bphoto\s+documentation\b"), ("written approval", r"\bwritten\s+approval\b"), ("written acceptance", r"\bwritten\s+acceptance\b"), ("signed record", r"\bsigned\s+record\b"),
    ("sign-off", r"\bsign[-\s]?off\b"), ("as-built", r"\bas[-\s]?built\b"), ("submittal", r"\bsubmittal\b"), ("checklist", r"\bchecklist\b"), ("field report", r"\bfield\s+report\b"), ("manufacturer letter", r"\bmanufacturer(?:'s)?\s+letter\b"),
    ("warranty", r"\bwarranty\b"), ("closeout document", r"\bcloseout\s+document\b"),
]
ACCEPTANCE_PARTIES = [
    ("owner", r"\bowner\b|\bowner's\s+representative\b"), ("va", r"\bveterans\s+affairs\b|\bdepartment\s+of\s+veterans\s+affairs\b|\bva\b"), ("cor", r"\bcontracting\s+officer(?:'s)?\s+representative\b|\bcor\b"),
    ("contracting_officer", r"\bcontracting\s+officer\b"), ("owner_qc", r"\bowner(?:'s)?\s+(?:qa|qc|quality\s+(?:assurance|control)|inspector)\b"), ("cqc", r"\bcqc\b|\bcontractor(?:'s)?\s+quality\s+control\b"),
    ("oit", r"\boit\b|\boffice\s+of\s+information\s+(?:and\s+)?technology\b"), ("ahj", r"\bauthority\s+having\s+jurisdiction\b|\bahj\b"), ("architect", r"\barchitect\b"), ("engineer", r"\bengineer\b|\bengineer\s+of\s+record\b"),
    ("manufacturer", r"\bmanufacturer\b"), ("testing_agency", r"\bindependent\s+testing\s+agency\b|\btesting\s+agency\b"), ("contractor", r"\bcontractor\b|\bprime\s+contractor\b|\bgeneral\s+contractor\b"),
]
ACCEPTANCE_NEGATION = r"\bnot\s+required\b|\bwithout\s+approval\b|\bshall\s+not\s+be\s+accepted\b|\bnot\s+acceptable\b|\bdoes\s+not\s+constitute\s+acceptance\b"
ACCEPTANCE_THRESHOLD = (
    r"\b\d+(?:\.\d+)?\s*(?:%|percent)\b|\bnot\s+less\s+than\b|\bnot\s+more\s+than\b|\bminimum\b|\bmaximum\b|\bwithin\s+\d+\b|\bzero\s+(?:defects|critical\s+punch|open\s+items)\b"
    r"|\bpass(?:ing)?\s+(?:score|result|criteria)\b|\bmeets?\s+(?:the\s+)?requirements\b|\bcomplies?\s+with\b"
)
ACCEPTANCE_PREREQUISITE = [
    r"\bafter\s+([^.;]+)", r"\bupon\s+completion\s+of\s+([^.;]+)", r"\bsubject\s+to\s+([^.;]+)", r"\bprovided\s+that\s+([^.;]+)", r"\bwhen\s+([^.;]+)", r"\bonce\s+([^.;]+)",
]
ACCEPTANCE_SUBJECT_ENDS = r"\b(?:shall|must|required|approved|accepted|verified|tested|inspected|certified|completed|released|commissioned)\b"

# Levels of compliance requirements with their weights, and what they call for.
COMPLIANCE_LEVELS = [
    ("shall", r"\bshall\b", 0.98), ("must", r"\bmust\b", 0.98), ("required", r"\brequired\s+to\b|\bis\s+required\b", 0.96), ("will", r"\bwill\b", 0.86), ("should", r"\bshould\b", 0.75), ("may", r"\bmay\b", 0.55),
    ("prohibited", r"\bshall\s+not\b|\bmust\s+not\b|\bprohibited\b|\bnot\s+permitted\b", 0.99),
]
COMPLIANCE_PARTIES = [
    ("contractor", r"\b(?:contractor|prime contractor|general contractor)\b"), ("cqc", r"\b(?:cqc|contractor quality control|quality control manager)\b"), ("owner_qc", r"\b(?:owner(?:'s)? qc|owner quality assurance|va qc|government inspector)\b"),
    ("cor", r"\b(?:contracting officer'?s representative|cor)\b"), ("contracting_officer", r"\bcontracting officer\b"), ("designer", r"\b(?:architect|engineer|designer|a/e)\b"),
    ("commissioning_agent", r"\b(?:commissioning agent|commissioning authority|cxa)\b"), ("oit", r"\b(?:oit|office of information and technology)\b"), ("fire_marshal", r"\b(?:fire marshal|fire protection engineer)\b"), ("ahj", r"\b(?:authority having jurisdiction|ahj)\b"),
]
COMPLIANCE_AUTHORITIES = [
    ("contracting_officer", r"\bcontracting officer\b"), ("cor", r"\bcor\b|contracting officer'?s representative"), ("owner", r"\bowner\b|\bgovernment\b|\bva\b"), ("ahj", r"\bahj\b|authority having jurisdiction"),
]
COMPLIANCE_EVIDENCE = [
    ("photo", r"\bphoto(?:graph)?s?\b"), ("inspection_report", r"\binspection\s+(?:report|record|log)\b|\binspected\b"), ("test_report", r"\btest\s+(?:report|record|result|data)\b|\btested\b"),
    ("submittal", r"\bsubmittal\b|\bshop drawing\b|\bproduct data\b"), ("approval", r"\bwritten approval\b|\bapproved submittal\b|\bapproval letter\b"), ("commissioning_report", r"\bcommissioning\s+(?:report|record)\b"),
    ("daily_report", r"\bdaily\s+(?:report|log)\b"), ("checklist", r"\bchecklist\b"), ("certificate", r"\bcertificate\b|\bcertification\b"), ("punchlist", r"\bpunch\s*list\b|\bdeficienc(?:y|ies)\b"), ("closeout", r"\bclose[- ]?out\b|\bturnover package\b"),
    ("training", r"\btraining\s+(?:record|roster|certificate)\b"), ("record_drawing", r"\b(?:record|as[- ]built)\s+drawing\b"), ("o_and_m_manual", r"\boperations?\s+and\s+maintenance\s+manual\b|\bo&m\s+manual\b"),
    ("warranty", r"\bwarranty\s+(?:document|certificate|information)\b"), ("rfi", r"\brfi\b|\brequest for information\b"), ("asi", r"\basi\b|\barchitect'?s supplemental instruction\b"), ("change_order", r"\bchange order\b|\bmodification\b"),
    ("permit", r"\bpermit\b"), ("safety_plan", r"\bicra\b|\bpcra\b|\bsafety plan\b"),
]
COMPLIANCE_CALLS_FOR = [
    (r"\binspect(?:ion|ed)?\b", ["inspection_report", "checklist", "photo"]), (r"\btest(?:ing|ed)?\b", ["test_report", "certificate"]), (r"\bsubmit(?:tal)?\b", ["submittal"]), (r"\bapprove(?:d|al)?\b", ["approval", "submittal"]),
    (r"\bcommission(?:ing|ed)?\b", ["commissioning_report", "test_report"]), (r"\btrain(?:ing)?\b", ["training"]), (r"\bclose[- ]?out\b|\bturnover\b", ["closeout", "record_drawing", "o_and_m_manual", "warranty"]),
    (r"\bcertif(?:y|ied|ication)\b", ["certificate"]), (r"\bphoto(?:graph)?\b|\bdocument\b", ["photo", "daily_report", "checklist"]), (r"\bpermit\b", ["permit"]), (r"\bicra\b|\bpcra\b|\binfection control\b", ["safety_plan", "approval"]),
]
OUTCOME_PASS = r"\bpass(?:ed|ing)?\b|\bacceptable\b|\bcompliant\b|\bapproved\b|\bsatisfactory\b|\bcomplete(?:d)?\b"
OUTCOME_FAIL = r"\bfail(?:ed|ure)?\b|\breject(?:ed|ion)?\b|\bnon[- ]?compliant\b|\bdeficien(?:t|cy)\b|\bunsatisfactory\b"
OUTCOME_WAIVER = r"\bwaiv(?:e|ed|er)\b|\bexception approved\b|\bvariance\b"
COMPLIANCE_STATUS = [
    ("not_applicable", r"\bnot applicable\b|\bn/a\b"), ("waived", OUTCOME_WAIVER), ("non_compliant", OUTCOME_FAIL), ("compliant", OUTCOME_PASS), ("pending", r"\bpending\b|\bawaiting\b|\bopen\b"), ("blocked", r"\bblocked\b|\bon hold\b"),
]

# Activities of workflows with their phases and weights, and what is named beside them.
WORKFLOW_ACTIVITIES = [
    ("submit", "submittal", 0.96, [r"\bshall\s+submit\b", r"\bsubmit(?:tal)?\b", r"\bprovide\s+for\s+review\b"]), ("review", "submittal", 0.90, [r"\breview(?:ed)?\b", r"\btechnical\s+review\b"]),
    ("approve", "submittal", 0.96, [r"\bshall\s+be\s+approved\b", r"\bapproval\s+required\b", r"\bapproved\s+prior\s+to\b"]), ("coordinate", "planning", 0.88, [r"\bcoordinate\b", r"\bcoordination\s+required\b"]),
    ("procure", "procurement", 0.86, [r"\bprocure\b", r"\bpurchase\b", r"\border\b"]), ("deliver", "procurement", 0.84, [r"\bdeliver\b", r"\breceive\b", r"\bon[- ]site\s+delivery\b"]),
    ("store", "procurement", 0.82, [r"\bstor(?:e|age)\b", r"\bprotect\s+materials\b"]), ("shutdown", "preinstallation", 0.95, [r"\bshutdown\b", r"\bservice\s+interruption\b", r"\boutage\b"]),
    ("permit", "preinstallation", 0.92, [r"\bpermit\b", r"\bwork\s+authorization\b"]), ("protect", "preinstallation", 0.88, [r"\bprotect\b", r"\btemporary\s+protection\b"]),
    ("remove", "installation", 0.84, [r"\bremove\b", r"\bdemolish\b", r"\bdisconnect\b"]), ("install", "installation", 0.96, [r"\bshall\s+install\b", r"\binstallation\b", r"\bfurnish\s+and\s+install\b"]),
    ("connect", "installation", 0.90, [r"\bconnect\b", r"\bterminate\b", r"\bsplice\b"]), ("label", "installation", 0.84, [r"\blabel\b", r"\bidentify\b", r"\btag\b"]),
    ("inspect", "inspection", 0.96, [r"\binspect(?:ion|ed)?\b", r"\bverify\s+installation\b"]), ("witness", "inspection", 0.94, [r"\bwitness\b", r"\bin\s+the\s+presence\s+of\b"]),
    ("test", "testing", 0.96, [r"\btest(?:ing|ed)?\b", r"\bfunctional\s+performance\b"]), ("certify", "testing", 0.92, [r"\bcertif(?:y|ied|ication)\b"]),
    ("commission", "commissioning", 0.97, [r"\bcommission(?:ing|ed)?\b", r"\bstartup\b"]), ("train", "closeout", 0.90, [r"\btrain(?:ing)?\b", r"\binstruction\s+to\s+owner\b"]),
    ("accept", "acceptance", 0.97, [r"\baccept(?:ance|ed)?\b", r"\bowner\s+acceptance\b"]), ("closeout", "closeout", 0.96, [r"\bclose[- ]?out\b", r"\bfinal\s+completion\b", r"\bturnover\b"]),
    ("warranty", "warranty", 0.90, [r"\bwarranty\b", r"\bguarantee\b"]),
]
WORKFLOW_STATUS = [
    ("complete", r"\bcomplete(?:d)?\b|\bclosed\b|\bapproved\b|\bpassed\b"), ("in_progress", r"\bin\s+progress\b|\bongoing\b|\bstarted\b"), ("blocked", r"\bblocked\b|\bon\s+hold\b|\bawaiting\b|\bpending\b"),
    ("failed", r"\bfailed\b|\bdeficient\b|\bnon[- ]?conforming\b"), ("rejected", r"\brejected\b|\bdisapproved\b"), ("deferred", r"\bdeferred\b|\bpostponed\b"),
]
WORKFLOW_PARTIES = [
    ("contractor", r"\b(?:contractor|prime contractor|general contractor)\b"), ("cqc", r"\b(?:cqc|contractor quality control|quality control manager)\b"), ("owner_qc", r"\b(?:owner(?:'s)? qc|owner quality assurance|va qc|government inspector)\b"),
    ("cor", r"\b(?:contracting officer'?s representative|cor)\b"), ("co", r"\b(?:contracting officer|co)\b"), ("designer", r"\b(?:architect|engineer|designer|a/e)\b"),
    ("commissioning_agent", r"\b(?:commissioning agent|commissioning authority|cxa)\b"), ("oit", r"\b(?:oit|office of information and technology|information technology)\b"), ("fire_marshal", r"\b(?:fire marshal|fire protection engineer)\b"),
    ("ahj", r"\b(?:authority having jurisdiction|ahj)\b"),
]
WORKFLOW_EVIDENCE = [
    ("photo", r"\bphoto(?:graph)?s?\b"), ("inspection_report", r"\binspection\s+report\b"), ("test_report", r"\btest\s+report\b"), ("certificate", r"\bcertificate\b"), ("record_drawing", r"\b(?:record|as[- ]built)\s+drawing\b"),
    ("om_manual", r"\boperation(?:s)?\s+and\s+maintenance\s+manual\b|\bo&m\s+manual\b"), ("training_record", r"\btraining\s+record\b|\battendance\s+sheet\b"), ("warranty", r"\bwarranty\s+(?:document|certificate|information)\b"),
    ("commissioning_report", r"\bcommissioning\s+report\b"), ("approval_record", r"\bwritten\s+approval\b|\bapproval\s+letter\b"),
]
WORKFLOW_PRECONDITIONS = [
    ("approval", r"\b(?:after|upon|subject to)\s+(?:written\s+)?approval\b"), ("approval", r"\bprior\s+approval\b"), ("inspection", r"\bafter\s+(?:inspection|verification)\b"), ("testing", r"\bafter\s+(?:successful\s+)?test(?:ing)?\b"),
    ("document", r"\bafter\s+(?:receipt|submission)\s+of\b"), ("safety approval", r"\b(?:after|upon)\s+(?:icra|pcra|safety)\s+approval\b"), ("shutdown approval", r"\bafter\s+(?:shutdown|outage)\s+approval\b"),
    ("access", r"\bafter\s+(?:access|area)\s+(?:is\s+)?available\b"),
]
ACTIVITY_OBJECT_ENDS = r"\b(?:before|after|prior to|upon|unless|when|where)\b.*$"
