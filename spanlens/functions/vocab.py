"""Vocabularies, rule tables and word lists that results depend on.

Everything here is plain data. Rule tables are ordered: the first pattern that fits decides. Callers
may pass their own tables to the functions of ``rules``.
"""

# --- fixed values: closed vocabularies -------------------------------------------------------------
ACTION_VOCABULARY = [
    "apply", "attach", "contact", "cut", "deliver", "emit", "grasp", "guide", "hold", "insert", "loop_around",
    "manipulate", "move", "other_action", "pass_through", "pierce", "position", "press", "pull", "push", "remove",
    "tighten",
]

ENTITY_VOCABULARY = [
    "clear_fluid", "clip_like_object", "cutting_instrument", "drape", "generic_instrument", "generic_material",
    "generic_object", "generic_structure", "grasping_instrument", "grid_like_material", "hand",
    "membranous_structure", "needle_like_instrument", "opening", "patch_material", "probe_instrument", "red_fluid",
    "ring_like_object", "suction_instrument", "surface_region", "thread_like_material", "tissue", "tissue_region",
    "tubular_instrument", "tubular_structure",
]

# Concepts too general to show that two clips are about the same thing.
STOP_CONCEPTS = [
    "clear_fluid", "generic_instrument", "generic_material", "generic_object", "generic_structure", "red_fluid",
    "surface_region", "tissue", "tissue_region",
]

# Concepts a question may not be matched on.
GENERIC_QUERY_CONCEPTS = [
    "generic_instrument", "generic_material", "generic_object", "generic_structure", "surface_region",
    "tissue_region",
]

TERMINAL_ACTIONS = ["attach", "cut", "remove", "tighten"]

# --- fixed values: attribute rules, group -> (pattern, value) --------------------------------------
ATTRIBUTE_RULES = {
    "color": [
        (r"\b(?:red|reddish)\b", "red"),
        (r"\b(?:blue|bluish)\b", "blue"),
        (r"\b(?:white|whitish)\b", "white"),
        (r"\b(?:yellow|yellowish)\b", "yellow"),
        (r"\b(?:pink|pinkish)\b", "pink"),
        (r"\bpurple\b", "purple"),
        (r"\borange\b", "orange"),
        (r"\bblack\b", "black"),
        (r"\bdark\b", "dark"),
        (r"\bpale\b", "pale"),
    ],
    "appearance": [
        (r"\bfatty-looking\b", "fatty-looking"),
        (r"\b(?:glossy|glistening|shiny)\b", "glossy"),
        (r"\bsmooth\b", "smooth"),
        (r"\bmoist\b", "moist"),
        (r"\bfibrous\b", "fibrous"),
        (r"\bgranular\b", "granular"),
        (r"\btextured\b", "textured"),
        (r"\bporous\b", "porous"),
        (r"\birregular(?:ly shaped)?\b", "irregular"),
        (r"\b(?:clear|transparent|translucent)\b", "translucent"),
    ],
    "shape": [
        (r"\b(?:tubular|tube-like|cylindrical)\b", "tubular"),
        (r"\b(?:rounded|round)\b", "round"),
        (r"\boval(?:-shaped)?\b", "oval"),
        (r"\bcircular\b", "circular"),
        (r"\b(?:ring-like|ring)\b", "ring"),
        (r"\b(?:lobed|lobulated)\b", "lobed"),
        (r"\bsquare\b", "square"),
        (r"\brectangular\b", "rectangular"),
        (r"\bflat\b", "flat"),
        (r"\bcurved\b", "curved"),
        (r"\bpointed\b", "pointed"),
        (r"\bserrated\b", "serrated"),
        (r"\bbranching\b", "branching"),
    ],
    "size": [(r"\bsmall\b", "small"), (r"\bthin\b", "thin"), (r"\blong\b", "long")],
    "material": [(r"\b(?:metal|metallic)\b", "metal"), (r"\bplastic\b", "plastic")],
}

# --- fixed values: entity rules, (pattern, canonical, category) ------------------------------------
ENTITY_RULES = [
    (r"\bmesh-covered tubular structure\b", "tubular_structure", "anatomy"),
    (r"\b(?:suture|thread|strands?)(?:-like)?(?: materials?)?\b", "thread_like_material", "material"),
    (r"\b(?:mesh|mesh-like|grid-like)(?: structures?| materials?| rings?| coverings?)?\b", "grid_like_material", "material"),
    (r"\bblood\b(?!\s+vessels?\b)|\bred fluid(?: droplets?| pools?| streaks?)?\b", "red_fluid", "object"),
    (r"\bclear fluid(?: droplets?)?\b", "clear_fluid", "object"),
    (r"\b(?:forceps|grasper|clamp|needle holder)(?:-like)?\b", "grasping_instrument", "instrument"),
    (r"\bneedle-like instrument\b", "needle_like_instrument", "instrument"),
    (r"\b(?:scissors?|scissor-like tool|cutting instrument|blade-like instrument)\b", "cutting_instrument", "instrument"),
    (r"\b(?:suction|aspiration) (?:instrument|tool|tube)\b", "suction_instrument", "instrument"),
    (r"\b(?:probe|orange-tipped tool)\b", "probe_instrument", "instrument"),
    (
        r"\b(?:tubular|tube-like|cylindrical|clear|red) (?:instrument|tool|device|tube)\b|\btubular access port\b",
        "tubular_instrument",
        "instrument",
    ),
    (r"\b(?:instrument|tool)s?(?: with [^,]+)?\b", "generic_instrument", "instrument"),
    (r"\b(?:blood\s+)?vessels?\b", "tubular_structure", "anatomy"),
    (r"\btubular (?:structure|object)s?\b", "tubular_structure", "anatomy"),
    (r"\b(?:opening|cavity)\b", "opening", "anatomy"),
    (r"\b(?:organ|body cavity|surgical site)\b", "tissue_region", "anatomy"),
    (r"\bmembran(?:e|ous)(?: layer| structure| surface)?s?\b", "membranous_structure", "anatomy"),
    (
        r"\b(?:reddish|pinkish|yellowish|white|whitish|smooth|pale|fatty-looking)?\s*tissue(?: layers?| mass| fragments?)?\b",
        "tissue",
        "anatomy",
    ),
    (r"\b(?:patch|square material|rectangular material)\b", "patch_material", "material"),
    (r"\b(?:clip|anchor)\b", "clip_like_object", "object"),
    (r"\bring-like object\b|\bwhite ring\b", "ring_like_object", "object"),
    (r"\b(?:gloved )?hand\b", "hand", "object"),
    (r"\b(?:drape|gown)s?\b", "drape", "object"),
    (r"\bsurfaces?\b", "surface_region", "anatomy"),
]

# Word classes tried when no entity rule fits: (pattern, canonical, category, does the hint win?).
ENTITY_FALLBACKS = [
    (r"\b(?:material|substance|strands?)\b", "generic_material", "material", False),
    (r"\b(?:surface|lining|wall|edge)\b", "surface_region", "anatomy", True),
    (r"\b(?:structure|mass)\b", "generic_structure", "object", True),
    (r"\b(?:object|device)\b", "generic_object", "object", True),
]
# Then the hint alone decides; anything else is a generic object.
HINT_FALLBACKS = [
    ("instrument", "generic_instrument"),
    ("anatomy", "tissue_region"),
    ("material", "generic_material"),
]

# --- fixed values: action rules, (pattern, predicates) ---------------------------------------------
ACTION_RULES = [
    (r"\b(?:is |being )?pull(?:s|ed|ing)? and (?:tighten(?:s|ed|ing)?|tension(?:s|ed|ing)?)\b", ["pull", "tighten"]),
    (
        r"\b(?:is |being )?loop(?:s|ed|ing)? and (?:tighten(?:s|ed|ing)?|tension(?:s|ed|ing)?)\b",
        ["loop_around", "tighten"],
    ),
    (r"\b(?:is |being )?pull(?:s|ed|ing)? and loop(?:s|ed|ing)?\b", ["pull", "loop_around"]),
    (r"\bgrasp(?:s|ed|ing)? and pull(?:s|ed|ing)?\b", ["grasp", "pull"]),
    (r"\bgrasp(?:s|ed|ing)? and retract(?:s|ed|ing)?\b", ["grasp", "pull"]),
    (r"\bhold(?:s|ing)? and pull(?:s|ed|ing)?\b", ["hold", "pull"]),
    (r"\bgrasp(?:s|ed|ing)? and hold(?:s|ing)?\b", ["grasp", "hold"]),
    (r"\bhold(?:s|ing)? and retract(?:s|ed|ing)?\b", ["hold", "pull"]),
    (r"\bpull(?:s|ed|ing)? and retract(?:s|ed|ing)?\b", ["pull"]),
    (r"\bpull(?:s|ed|ing)? and position(?:s|ed|ing)?\b", ["pull", "position"]),
    (r"\bhold(?:s|ing)? and position(?:s|ed|ing)?\b", ["hold", "position"]),
    (r"\bhold(?:s|ing)? and guid(?:e|es|ed|ing)?\b", ["hold", "guide"]),
    (r"\bhold(?:s|ing)? and maneuver(?:s|ed|ing)?\b", ["hold", "manipulate"]),
    (r"\bpush(?:es|ed|ing)? and guid(?:e|es|ed|ing)?\b", ["push", "guide"]),
    (r"\bpush(?:es|ed|ing)? and pull(?:s|ed|ing)?\b", ["push", "pull"]),
    (r"\binsert(?:s|ed|ing)? and guid(?:e|es|ed|ing)?\b", ["insert", "guide"]),
    (r"\binsert(?:s|ed|ing)? and pull(?:s|ed|ing)?\b", ["insert", "pull"]),
    (r"\bcontact(?:s|ed|ing)? and manipulat(?:e|es|ed|ing)\b", ["contact", "manipulate"]),
    (r"\bemit(?:s|ted|ting)? [^,]* and contact(?:s|ed|ing)?\b", ["emit", "contact"]),
    (r"\bgrasp(?:s|ed|ing)? and adjust(?:s|ed|ing)?\b", ["grasp", "manipulate"]),
    (r"\bpierc(?:e|es|ed|ing) and pull(?:s|ed|ing)?\b", ["pierce", "pull"]),
    (
        r"\b(?:pass(?:es|ed|ing)?|push(?:es|ed|ing)?|insert(?:s|ed|ing)?)(?: [a-z-]+){0,4} through(?: tissue)?\b",
        ["pass_through"],
    ),
    (r"\bpull(?:s|ed|ing)?(?: [a-z-]+){0,4} through(?: tissue)?\b", ["pass_through"]),
    (r"\bmov(?:e|es|ed|ing) through\b", ["pass_through"]),
    (r"\bpass(?:es|ed|ing)?(?: thread-like material)?\b", ["pass_through"]),
    (r"\b(?:form(?:s|ed|ing)? )?loops? around(?: tissue)?\b", ["loop_around"]),
    (r"\b(?:is |being )?loop(?:s|ed|ing)? around\b", ["loop_around"]),
    (r"\barrang(?:e|es|ed|ing) around\b", ["loop_around"]),
    (r"\bstretch(?:es|ed|ing)?\b|\bheld taut\b", ["tighten"]),
    (r"\btighten(?:s|ed|ing)?\b|\btension(?:s|ed|ing)?\b", ["tighten"]),
    (r"\bappl(?:y|ies|ied|ying) pressure\b", ["press"]),
    (r"\binsert(?:s|ed|ing)?(?: into(?: tissue| opening)?)?\b", ["insert"]),
    (r"\bhold(?:s|ing)?(?: tissue)?\b", ["hold"]),
    (r"\bgrasp(?:s|ed|ing)?\b", ["grasp"]),
    (r"\bpull(?:s|ed|ing)?(?: thread-like material)?\b", ["pull"]),
    (r"\bpress(?:es|ed|ing)?(?: against)?(?: tissue)?\b", ["press"]),
    (r"\bcontact(?:s|ed|ing)?\b", ["contact"]),
    (r"\btouch(?:es|ed|ing)?\b", ["contact"]),
    (r"\bmanipulat(?:e|es|ed|ing)\b", ["manipulate"]),
    (r"\bmov(?:e|es|ed|ing)\b", ["move"]),
    (r"\bretract(?:s|ed|ing)?\b", ["pull"]),
    (r"\bguid(?:e|es|ed|ing)?\b", ["guide"]),
    (r"\b(?:emit(?:s|ted|ting)?|expel(?:s|led|ling)?|releas(?:e|es|ed|ing))\b", ["emit"]),
    (r"\bdeliver(?:s|ed|ing)?\b", ["deliver"]),
    (r"\bremov(?:e|es|ed|ing)\b", ["remove"]),
    (r"\bsecur(?:e|es|ed|ing)\b", ["attach"]),
    (r"\battach(?:es|ed|ing)?\b", ["attach"]),
    (r"\bplac(?:e|es|ed|ing) (?:on|onto)\b", ["position"]),
    (r"\bposition(?:s|ed|ing)?\b", ["position"]),
    (r"\bpush(?:es|ed|ing)?\b", ["push"]),
    (r"\bpierc(?:e|es|ed|ing)\b", ["pierce"]),
    (r"\bcut(?:s|ting)?\b", ["cut"]),
    (r"\bappl(?:y|ies|ied|ying)\b", ["apply"]),
]

# --- fixed values: allowed action sequences and the shared concepts that support them --------------
TRANSITION_SUPPORT = {
    ("grasp", "pull"): ["grid_like_material", "membranous_structure", "thread_like_material", "tubular_structure"],
    ("guide", "pass_through"): ["needle_like_instrument", "thread_like_material"],
    ("hold", "pull"): ["grid_like_material", "thread_like_material", "tubular_structure"],
    ("insert", "guide"): ["needle_like_instrument", "thread_like_material"],
    ("insert", "pass_through"): ["needle_like_instrument", "thread_like_material", "tubular_structure"],
    ("loop_around", "pull"): ["thread_like_material"],
    ("loop_around", "tighten"): ["thread_like_material"],
    ("pass_through", "loop_around"): ["thread_like_material"],
    ("pass_through", "pull"): ["grid_like_material", "thread_like_material", "tubular_structure"],
    ("position", "loop_around"): ["thread_like_material"],
    ("pull", "loop_around"): ["thread_like_material"],
    ("pull", "position"): ["thread_like_material"],
    ("pull", "tighten"): ["thread_like_material"],
}

# --- fixed values: question wording ----------------------------------------------------------------
ACTION_ALIASES = {
    "apply": ["application"],
    "attach": ["attachment", "secure", "securing"],
    "cut": ["cutting", "division"],
    "grasp": ["grasping", "grip", "gripping"],
    "guide": ["guidance", "guiding"],
    "insert": ["insertion", "introduce", "introduction"],
    "loop_around": ["looping", "loop around", "loops around"],
    "pass_through": ["passage", "pass through", "passes through", "passing through"],
    "pierce": ["piercing", "puncture", "puncturing"],
    "position": ["placement", "positioning"],
    "press": ["pressure", "compression", "pressing"],
    "pull": ["traction", "retraction", "pulling"],
    "remove": ["removal", "withdrawal"],
    "tighten": ["tightening", "tensioning", "tension"],
}

QUESTION_SPLIT_PATTERN = r"[?.,;:]|\b(?:after|before|then|while|followed by|and)\b"

STOPWORDS = [
    "a", "after", "an", "and", "are", "at", "being", "before", "by", "does", "during", "for", "from", "happen",
    "happens", "how", "in", "interval", "intervals", "is", "it", "like", "of", "on", "or", "show", "shows", "the",
    "then", "to", "what", "when", "where", "which", "with",
]

# Terms a literal clip summary must not contain, in report order.
SUMMARY_FORBIDDEN_TERMS = [
    "possibly",
    "likely",
    "may",
    "blood",
    "bleeding",
    "surgical",
    "surgical field",
    "surgical work",
    "procedure",
    "suture",
    "suturing",
    "irrigation",
    "blood vessel",
    "inflamed",
    "dissection",
    "resection",
    "repair",
    "ligation",
]

DESCRIPTION_KEYS = ["medical_inferences", "observed_facts", "summary", "uncertainties"]
OBSERVED_KEYS = [
    "actions",
    "state_changes",
    "visible_anatomy",
    "visible_instruments",
    "visible_objects",
    "visual_evidence",
]

# --- fixed values: graph types ---------------------------------------------------------------------
NODE_TYPES = [
    "segment", "phase", "action", "instrument", "anatomy", "finding", "entity_mention", "concept", "action_event",
    "temporal_event",
]
EDGE_TYPES = [
    "temporal_before", "contains", "uses", "acts_on", "causes", "same_entity", "co_occurs", "observed_in",
    "instance_of", "has_subject", "part_of", "possible_continuation",
]
REASONING_TYPES = ["single_hop", "multi_hop", "comparison", "causal", "temporal_order"]
