"""Fixed values of note data: roles of programs and drum notes, and the leaves a role may become."""

# Program range (first, last) -> role (fixed values). Programs in no range have no role.
PROGRAM_ROLES = (
    (0, 7, "keys_piano"), (9, 9, "mallet"), (11, 13, "mallet"), (16, 20, "organ"),
    (21, 21, "accordion"), (22, 22, "harmonica"), (23, 23, "accordion"), (24, 31, "guitar"),
    (32, 39, "bass"), (40, 42, "strings_solo"), (44, 44, "strings_section"), (46, 46, "harp"),
    (48, 49, "strings_section"), (56, 61, "brass"), (64, 71, "reed"), (72, 73, "flute"),
    (80, 87, "synth_lead"), (88, 95, "synth_pad"), (105, 105, "plucked"),
)
# Notes of the drum channel that belong to the kit, and to each other percussion part (fixed values).
KIT_NOTES = (35, 36, 37, 38, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 55, 57, 59)
CYMBAL_NOTES = (42, 44, 46, 49, 51, 52, 53, 55, 57, 59)
PERCUSSION_NOTES = {
    "perc_tambourine": (54,), "perc_shaker": (69, 70, 82), "perc_claps": (39,),
    "perc_hand_drums": (60, 61, 62, 63, 64),
}
# Leaves a role may be rendered as (fixed values).
ROLE_LEAVES = {
    "keys_piano": ("keys.piano", "keys.electric_piano.rhodes", "keys.electric_piano.fm"),
    "organ": ("keys.organ.drawbar",),
    "guitar": ("guitar.acoustic.nylon", "guitar.acoustic.steel", "guitar.electric.clean",
               "guitar.electric.distorted"),
    "bass": ("bass.electric.picked", "bass.electric.fingered", "bass.upright", "bass.synth.analog",
             "bass.synth.sub_808"),
    "brass": ("brass.trumpet", "brass.trombone", "brass.french_horn", "brass.tuba", "brass.section"),
    "reed": ("woodwinds.saxophone.tenor", "woodwinds.saxophone.soprano", "woodwinds.saxophone.alto",
             "woodwinds.saxophone.baritone", "woodwinds.clarinet", "woodwinds.oboe",
             "woodwinds.bassoon"),
    "flute": ("woodwinds.flute",), "harmonica": ("woodwinds.harmonica",),
    "accordion": ("keys.accordion",),
    "strings_solo": ("strings.bowed.violin", "strings.bowed.viola", "strings.bowed.cello",
                     "strings.bowed.section"),
    "strings_section": ("strings.bowed.section",), "harp": ("strings.plucked.harp",),
    "plucked": ("strings.plucked.banjo", "strings.plucked.mandolin"),
    "mallet": ("percussion.mallet.glockenspiel", "percussion.mallet.vibraphone",
               "percussion.mallet.marimba", "percussion.mallet.xylophone"),
    "synth_lead": ("keys.synth.lead", "keys.synth.pluck"), "synth_pad": ("keys.synth.pad",),
    "drums": ("drums.acoustic_kit", "drums.electronic.tr808"),
    "perc_tambourine": ("percussion.tambourine",), "perc_shaker": ("percussion.shaker",),
    "perc_claps": ("percussion.claps",), "perc_hand_drums": ("percussion.hand_drums",),
}
# Programs whose name fixes the leaf, or a subset of them (fixed values).
PROGRAM_LEAVES = {
    0: ("keys.piano",), 1: ("keys.piano",), 2: ("keys.piano",), 3: ("keys.piano",),
    4: ("keys.electric_piano.rhodes",), 5: ("keys.electric_piano.fm",),
    9: ("percussion.mallet.glockenspiel",), 11: ("percussion.mallet.vibraphone",),
    12: ("percussion.mallet.marimba",), 13: ("percussion.mallet.xylophone",),
    21: ("keys.accordion",), 22: ("woodwinds.harmonica",), 23: ("keys.accordion",),
    24: ("guitar.acoustic.nylon",), 25: ("guitar.acoustic.steel",), 26: ("guitar.electric.clean",),
    27: ("guitar.electric.clean",), 28: ("guitar.electric.clean",),
    29: ("guitar.electric.distorted",), 30: ("guitar.electric.distorted",), 32: ("bass.upright",),
    33: ("bass.electric.fingered",), 34: ("bass.electric.picked",),
    38: ("bass.synth.analog", "bass.synth.sub_808"), 39: ("bass.synth.analog", "bass.synth.sub_808"),
    40: ("strings.bowed.violin",), 41: ("strings.bowed.viola",), 42: ("strings.bowed.cello",),
    44: ("strings.bowed.section",), 46: ("strings.plucked.harp",), 48: ("strings.bowed.section",),
    49: ("strings.bowed.section",), 56: ("brass.trumpet",), 57: ("brass.trombone",),
    58: ("brass.tuba",), 59: ("brass.trumpet",), 60: ("brass.french_horn",), 61: ("brass.section",),
    64: ("woodwinds.saxophone.soprano",), 65: ("woodwinds.saxophone.alto",),
    66: ("woodwinds.saxophone.tenor",), 67: ("woodwinds.saxophone.baritone",),
    68: ("woodwinds.oboe",), 69: ("woodwinds.oboe",), 70: ("woodwinds.bassoon",),
    71: ("woodwinds.clarinet",), 72: ("woodwinds.flute",), 73: ("woodwinds.flute",),
    105: ("strings.plucked.banjo",),
}
SOLO_LEAVES = ("strings.bowed.violin", "strings.bowed.viola", "strings.bowed.cello")
MAX_SOLO_POLYPHONY = 2
SHARED_BANKS = ("fluidr3_gm",)
