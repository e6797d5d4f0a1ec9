"""Rule tables of the transit feeds. Every function that uses one takes it as an argument, so another city brings its own.

All tables in this file are fixed values: results are right only if they equal the feeds' published conventions.
"""

from __future__ import annotations

# Canonical order of the lines.
LINE_ORDER = ["Red", "Blue", "Brown", "Green", "Orange", "Purple", "Pink", "Yellow"]

# Feed route code to line name.
ROUTE_LINES = {
    "Red": "Red", "Blue": "Blue", "Brn": "Brown", "G": "Green", "Org": "Orange", "P": "Purple",
    "Pexp": "Purple Express", "Pink": "Pink", "Y": "Yellow",
}

# The routes that have tracks.
TRACK_ROUTE_LINES = {code: line for code, line in ROUTE_LINES.items() if code != "Pexp"}

# Spellings of a line, in lower case.
LINE_ALIASES = {
    "purple express": "Purple", "purpleexpress": "Purple", "prp": "Purple", "pexp": "Purple",
    "red": "Red", "blue": "Blue", "brown": "Brown", "brn": "Brown", "green": "Green", "grn": "Green",
    "orange": "Orange", "org": "Orange", "purple": "Purple", "pink": "Pink", "pnk": "Pink",
    "yellow": "Yellow", "y": "Yellow",
}

# The line that the suffix of a compound name points to.
LINE_HINTS = {
    "O'Hare": "Blue", "North Main": "Red", "Brown": "Brown", "Cermak": "Pink", "Lake": "Green", "Chinatown": "Red",
    "Forest Park": "Blue", "Dan Ryan": "Red", "Bronzeville-IIT": "Green", "Skokie": "Yellow",
    "McCormick Place": "Green", "Milwaukee": "Blue", "State": "Red", "Franklin": "Brown", "Dearborn": "Blue",
    "Wells": "Orange", "Wabash": "Green", "Division": "Blue", "Clybourn": "Red", "Halsted": "Blue",
    "Archer": "Orange", "Howard": "Red", "Kimball": "Brown", "Ashland/63": "Green", "Cottage Grove": "Green",
    "Harlem": "Blue", "Cumberland": "Blue", "Jackson": "Blue", "Monroe": "Blue", "Adams": "Pink", "Madison": "Blue",
    "Grand": "Blue", "Express": "Purple", "O'Hare Airport": "Blue", "Midway Airport": "Orange",
    "Medical Center": "Blue", "Conservatory": "Green", "Library": "Brown",
}

# The line that the last hyphenated part of a stop name points to.
NAME_SUFFIX_LINES = {
    "Red": "Red", "Blue": "Blue", "Brown": "Brown", "Green": "Green", "Orange": "Orange", "Purple": "Purple",
    "Pink": "Pink", "Yellow": "Yellow", "O'Hare": "Blue", "Forest Park": "Blue", "Dan Ryan": "Red",
}

# Feed names that stand for stations of quite another name.
SPECIAL_NAMES = {
    "Library": ["Harold Washington Library-State/Van Buren"],
    "Medical Center": ["Illinois Medical District"],
    "O'Hare Airport": ["O'Hare"],
    "95th/Dan Ryan": ["95th", "95th/Ran Ryan", "95th/Dan Ryan"],
    "35-Bronzeville-IIT": ["35th-Bronzeville-IIT", "Bronzeville-IIT"],
    "Midway Airport": ["Midway"],
    "UIC-Halsted": ["UIC-Halsted", "Halsted (Blue)", "Halsted (Green)"],
    "54th/Cermak": ["54th/Cermak", "Cermak (Pink)"],
    "Cermak-McCormick Place": ["Cermak-McCormick Place", "McCormick Place"],
    "35th/Archer": ["35th/Archer", "Archer"],
    "Kedzie-Homan-Forest Park": ["Kedzie-Homan", "Kedzie (Blue - Forest Park Branch)"],
    "East 63rd-Cottage Grove": ["Cottage Grove", "63rd (Green)"],
    "Harlem-Forest Park": ["Harlem (Blue - Forest Park Branch)"],
    "Harlem-Lake": ["Harlem (Green)", "Harlem/Lake"],
    "Harlem-O'Hare": ["Harlem (Blue - O'Hare Branch)"],
    "State/Lake": ["State/Lake", "Lake (Red)"],
    "Conservatory": ["Conservatory-Central Park Drive", "Central Park"],
    "Oakton-Skokie": ["Oakton-Skokie", "Skokie"],
    "Jefferson Park": ["Jefferson Park"],
    "North/Clybourn": ["North/Clybourn"],
    "Adams/Wabash": ["Adams/Wabash"],
    "Clark/Division": ["Clark/Division"],
    "Clark/Lake": ["Clark/Lake"],
    "Division/Milwaukee": ["Division"],
    "Quincy/Wells": ["Quincy/Wells", "Quincy"],
    "Washington/Wells": ["Washington/Wells"],
    "Washington/Wabash": ["Washington/Wabash"],
    "Washington/Dearborn": ["Washington"],
}

# Feed name and the station name it is an alias of (resolved by start of name where needed).
KNOWN_ALIASES = [
    ("Kedzie-Midway", "Kedzie-Orange"), ("Midway Airport", "Midway"), ("Kedzie-Homan-Forest Park", "Kedzie-Homan"),
    ("Austin-Forest Park", "Austin (Blue)"), ("Oak Park-Forest Park", "Oak Park-Blue"),
    ("Cicero-Lake", "Cicero (Blue)"), ("Clinton-Forest Park", "Clinton-Blue"), ("Kedzie-Lake", "Kedzie-Homan"),
    ("Central-Lake", "Central Park"), ("Pulaski-Lake", "Pulaski (Blue)"), ("Austin-Lake", "Austin (Blue)"),
    ("California-Lake", "California (Blue)"), ("Harlem-Lake", "Harlem/Lake"), ("Oak Park-Lake", "Oak Park-Blue"),
    ("O'Hare Airport", "O'Hare"), ("Montrose-O'Hare", "Montrose-Blue"), ("Irving Park-O'Hare", "Irving Park-Blue"),
    ("Addison-O'Hare", "Addison-Blue"), ("Belmont-O'Hare", "Belmont-Blue"),
    ("Belmont-North Main", "Belmont (Red/Brown/Purple)"), ("Addison-North Main", "Addison (Red)"),
    ("Wilson", "Wilson"), ("95th/Dan Ryan", "95th/Dan Ryan"), ("Roosevelt", "Roosevelt"),
    ("Sox-35th-Dan Ryan", "Sox-35th"), ("47th-Dan Ryan", "47th (Red)"), ("Garfield-Dan Ryan", "Garfield (Red)"),
    ("63rd-Dan Ryan", "63rd"), ("Garfield-South Elevated", "Garfield (Green)"),
    ("47th-South Elevated", "47th (Green)"), ("Halsted/63rd", "Halsted (Green)"),
    ("Central-Evanston", "Central (Purple)"), ("Jackson/State", "Jackson (Red)"), ("State/Lake", "Lake (Subway)"),
    ("Lake/State", "Lake (Subway)"), ("Washington/State", "Washington"), ("Monroe/State", "Monroe (Red)"),
    ("Randolph/Wabash", "Washington/Wabash"), ("Madison/Wabash", "Washington/Wabash"),
    ("Washington/Dearborn", "Washington"), ("Monroe/Dearborn", "Monroe (Blue)"),
    ("Jackson/Dearborn", "Jackson (Blue)"), ("Quincy/Wells", "Quincy"), ("Clark/Lake", "Clark/Lake"),
    ("Chicago/Franklin", "Merchandise Mart (Brown/Purple)"), ("Library", "Harold Washington Library-State/Van Buren"),
    ("Damen-Lake", "Damen (Blue)"), ("Clinton-Lake", "Clinton (Green/Pink)"), ("Morgan-Lake", "Morgan (Green/Pink)"),
    ("Chicago/State", "Chicago (Red)"), ("Grand/State", "Grand (Red)"), ("Division/Milwaukee", "Division"),
    ("Chicago/Milwaukee", "Chicago (Blue)"), ("Grand/Milwaukee", "Grand (Blue)"),
    ("Damen/Milwaukee", "Damen (Blue)"), ("Western/Milwaukee", "Western (Blue - O'Hare Branch)"),
    ("California/Milwaukee", "California (Blue)"), ("Medical Center", "Illinois Medical District"),
    ("Homan", "Kedzie-Homan"), ("Skokie", "Dempster-Skokie"),
]

# Feed name and the exact station name that receives it as an alias.
ALIAS_RULES = [
    ("Kedzie-Homan-Forest Park", "Kedzie-Homan"), ("Jackson/State", "Jackson (Red)"),
    ("Randolph/Wabash", "Washington/Wabash"), ("Washington/Dearborn", "Washington (Blue)"),
    ("Quincy/Wells", "Quincy"), ("Kedzie-Lake", "Kedzie (Green)"), ("Cicero-Lake", "Cicero (Green)"),
    ("Skokie", "Dempster-Skobie (Yellow)"), ("Halsted/63rd", "Halsted (Green)"), ("Monroe/Dearborn", "Monroe (Blue)"),
    ("Damen-Lake", "Damen (Green)"), ("State/Lake", "Lake (Subway)"), ("Division/Milwaukee", "Division"),
    ("Austin-Forest Park", "Austin (Blue)"), ("Sox-35th-Dan Ryan", "Sox-35th"),
    ("Clinton-Lake", "Clinton (Green/Pink)"), ("Clinton-Forest Park", "Clinton (Blue)"),
    ("Chicago/Franklin", "Chicago (Brown/Purple)"), ("Western/Milwaukee", "Western (Blue)"),
    ("California-Lake", "California (Green)"), ("Clark/Lake", "Clark/Lake (Elevated)"),
    ("Belmont-O'Hare", "Belmont (Blue)"), ("Oak Park-Lake", "Oak Park (Green)"),
    ("Garfield-South Elevated", "Garfield (Green)"), ("Roosevelt", "Roosevelt"),
    ("Garfield-Dan Ryan", "Garfield (Red)"), ("Central-Lake", "Central (Green)"), ("Grand/Milwaukee", "Grand (Blue)"),
    ("Harlem-Lake", "Harlem (Green)"), ("Pulaski-Lake", "Pulaski (Green)"), ("47th-South Elevated", "47th (Green)"),
    ("Montrose-O'Hare", "Montrose (Blue)"), ("Grand/State", "Grand (Red)"), ("Wilson", "Wilson"),
    ("Morgan-Lake", "Morgan (Green/Pink)"), ("Madison/Wabash", "Washington/Wabash"), ("95th/Dan Ryan", "95th"),
    ("47th-Dan Ryan", "47th (Red)"), ("Irving Park-O'Hare", "Irving Park (Blue)"),
    ("Kedzie-Midway", "Kedzie (Orange)"), ("Midway Airport", "Midway"),
    ("Medical Center", "Illinois Medical District"), ("Oak Park-Forest Park", "Oak Park (Blue)"),
    ("California/Milwaukee", "California (Blue)"), ("Damen/Milwaukee", "Damen (Blue)"),
    ("Chicago/State", "Chicago (Red)"), ("Chicago/Milwaukee", "Chicago (Blue)"), ("O'Hare Airport", "O'Hare"),
    ("Monroe/State", "Monroe (Red)"), ("63rd-Dan Ryan", "63rd"), ("Addison-O'Hare", "Addison (Blue)"),
    ("Jackson/Dearborn", "Jackson (Blue)"), ("Central-Evanston", "Central"), ("Homan", "Kedzie-Homan"),
    ("Lake/State", "Lake (Subway)"), ("Library", "Harold Washington Library"), ("Austin-Lake", "Austin (Green)"),
    ("Addison-North Main", "Addison (Red)"), ("Belmont-North Main", "Belmont (Red/Brown/Purple)"),
    ("Washington/State", "Washington/Wabash"),
]

# Feed name and exact station name, for stations named after their branch.
BRANCH_ALIAS_RULES = [
    ("Roosevelt", "Roosevelt (Elevated)"), ("Addison-O'Hare", "Addison-Blue"), ("Belmont-O'Hare", "Belmont-Blue"),
    ("State/Lake", "Lake"), ("Grand/Milwaukee", "Grand-Blue"), ("Madison/Wabash", "Washington/Wabash"),
    ("Homan", "Kedzie-Homan"), ("Chicago/Milwaukee", "Chicago-Blue"), ("Western/Milwaukee", "Western-O'Hare"),
    ("Montrose-O'Hare", "Montrose-Blue"), ("Chicago/State", "Chicago-Red"), ("Chicago/Franklin", "Chicago-Brown"),
    ("Jackson/Dearborn", "Jackson-Blue"), ("Grand/State", "Grand-Red"), ("Quincy/Wells", "Quincy"),
    ("California/Milwaukee", "California-O'Hare"), ("95th/Dan Ryan", "95th"),
    ("Washington/Dearborn", "Washington-Blue"), ("Clark/Lake", "Clark/Lake (Elevated)"),
    ("Monroe/State", "Monroe-Red"), ("Irving Park-O'Hare", "Irving Park-Blue"), ("Monroe/Dearborn", "Monroe-Blue"),
    ("Washington/State", "Washington/Wabash"), ("Lake/State", "Lake"), ("Wilson", "Wilson-North Inner"),
    ("Jackson/State", "Jackson-Red"), ("O'Hare Airport", "O'Hare"), ("Damen/Milwaukee", "Damen-O'Hare"),
    ("Halsted/63rd", "Halsted-Green"), ("Garfield-South Elevated", "Garfield-Green"),
    ("Randolph/Wabash", "Washington/Wabash"), ("Division/Milwaukee", "Division"),
]

# Line assignments by LIKE pattern, then by exact name; a later rule overrides an earlier one.
LINE_RULES = [
    *[([f"%({line})%", f"%-{line}%"], [line])
      for line in ["Blue", "Red", "Green", "Brown", "Orange", "Purple", "Pink", "Yellow"]],
    (["Belmont (Red/Brown/Purple)"], ["Red", "Brown", "Purple"]),
    (["Fullerton"], ["Red", "Brown", "Purple"]),
    (["Howard"], ["Red", "Purple", "Yellow"]),
    (["Roosevelt", "Roosevelt (Elevated)"], ["Red", "Green", "Orange"]),
    (["Clark/Lake (Elevated)"], ["Blue", "Brown", "Green", "Orange", "Pink", "Purple"]),
    (["Washington/Wabash"], ["Brown", "Green", "Orange", "Pink", "Purple"]),
    (["Lake (Subway)", "State/Lake"], ["Red"]),
    (["Chicago (Brown/Purple)"], ["Brown", "Purple"]),
    (["Merchandise Mart"], ["Brown", "Purple"]),
    (["Clinton (Green/Pink)"], ["Green", "Pink"]),
    (["Morgan (Green/Pink)"], ["Green", "Pink"]),
    (["Ashland (Green/Pink)"], ["Green", "Pink"]),
    (["Addison", "Argyle", "Berwyn", "Bryn Mawr", "Cermak-Chinatown", "Granville", "Jarvis", "Lawrence", "Loyola",
      "Morse", "North/Clybourn", "Sheridan", "Thorndale", "Wilson"], ["Red"]),
    (["O'Hare"], ["Blue"]),
    (["Midway"], ["Orange"]),
]

# The complete assignment by exact name, applied after LINE_RULES; a later rule overrides an earlier one.
FULL_LINE_RULES = [
    (["Armitage (Brown/Purple)", "Sedgwick (Brown/Purple)", "Diversey (Brown/Purple)", "Wellington (Brown/Purple)",
      "Merchandise Mart (Brown/Purple)"], ["Brown", "Purple"]),
    (["Clark/Lake"], ["Blue", "Brown", "Green", "Orange", "Pink", "Purple"]),
    (["Adams/Wabash", "Washington/Wells", "LaSalle/Van Buren", "Quincy",
      "Harold Washington Library-State/Van Buren"], ["Brown", "Green", "Orange", "Pink", "Purple"]),
    (["LaSalle", "Washington", "Harrison", "Clark/Division"], ["Red"]),
    (["35th-Bronzeville-IIT", "47th", "63rd", "69th", "79th", "87th", "95th/Dan Ryan", "Cermak-McCormick Place",
      "Harrison", "Indiana", "King Drive", "Sox-35th", "Cottage Grove"], ["Red"]),
    (["Cumberland", "Harlem (Blue - O'Hare Branch)", "Rosemont", "Jefferson Park Transit Center", "Forest Park",
      "Harlem (Blue - Forest Park Branch)", "Illinois Medical District", "Racine", "UIC-Halsted",
      "Western (Blue - O'Hare Branch)", "Western (Blue - Forest Park Branch)", "Kedzie-Homan", "Polk", "Division",
      "Logan Square", "California"], ["Blue"]),
    (["Kimball", "Kedzie (Brown)", "Francisco", "Rockwell", "Western (Brown)", "Damen (Brown)", "Montrose (Brown)",
      "Irving Park (Brown)", "Addison (Brown)", "Paulina", "Southport"], ["Brown"]),
    (["Harlem/Lake", "Ridgeland", "Oak Park (Green)", "Central Park", "Conservatory-Central Park Drive",
      "Kedzie (Green)", "California (Green)", "Ashland/63rd", "63rd (Green)", "Cottage Grove", "King Drive", "Indiana",
      "35th-Bronzeville-IIT", "43rd", "47th (Green)", "51st"], ["Green"]),
    (["43rd", "47th (Green)", "51st", "Ashland/63rd", "Cottage Grove"], ["Green"]),
    (["King Drive", "Indiana", "35th-Bronzeville-IIT"], ["Green"]),
    (["Midway", "Pulaski (Orange)", "Kedzie (Orange)", "35th/Archer", "Ashland (Orange)", "Western (Orange)"],
     ["Orange"]),
    (["54th/Cermak", "Kostner", "Pulaski (Pink)", "Kedzie (Pink)", "California (Pink)", "Western (Pink)", "18th",
      "Polk", "Damen (Pink)", "Cicero (Pink)"], ["Pink"]),
    (["Linden", "Central (Purple)", "Noyes", "Foster", "Davis", "Dempster", "Main", "South Boulevard"], ["Purple"]),
    (["Dempster-Skokie", "Oakton-Skokie"], ["Yellow"]),
    (["Laramie"], ["Pink"]),
]

# Names of shared corridors by the lines of a segment; the first rule that holds wins.
# Kinds: "share" = at least that many of the lines, "all" = all of the lines, "equal" = just these lines.
CORRIDOR_RULES = [
    ("share", 3, ["Brown", "Green", "Orange", "Pink", "Purple"], "Loop"),
    ("all", 2, ["Brown", "Purple"], "North Main"),
    ("all", 2, ["Red", "Green"], "South Side"),
    ("equal", 2, ["Blue", "Pink"], "Forest Park"),
    ("equal", 2, ["Green", "Pink"], "West Side"),
]
LOOP_CORRIDOR = "Loop"

# The box in which coordinates are rounded to 4 instead of 5 decimals (west, east, south, north).
LOOP_BOX = (-87.64, -87.62, 41.87, 41.89)

# The box in which all tracks should lie (west, east, south, north).
PLAUSIBLE_BOX = (-88.0, -87.0, 41.0, 43.0)

# Mean radius of the earth in metres, tolerance of line simplification in degrees, length of a segment
# that is reported as long, offsets between parallel lines in pixels.
EARTH_RADIUS_M = 6371000.0
SIMPLIFY_TOLERANCE = 0.00003
# Fixed value: ends of segments that are closer than this in both coordinates, in degrees, are one vertex.
VERTEX_TOLERANCE = 0.000001
LONG_SEGMENT_M = 1000.0
OFFSET_STEP = 3.5
LOOP_OFFSET_STEP = 2.0

# Days kept in the daily table, windows of the averages, stations expected to have data.
RETENTION_DAYS = 365
SHORT_WINDOW_DAYS = 30
LONG_WINDOW_DAYS = 90
EXPECTED_STATIONS = 140
