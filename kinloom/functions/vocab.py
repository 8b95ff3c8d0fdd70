"""Word lists and patterns of the record normalisers, by version.

``early`` serves the 33-feature profile, ``v1`` the one after it, ``train`` and ``serve`` the two forms of the second one, ``fast`` the
rule-only path. The lists differ on purpose; results depend on which one a profile uses.
"""

from __future__ import annotations

# Lists that results must agree on.
STOPWORDS = {
    "base": "the a an and of for in on at to m s ms co".split(),
    "v1": "the a an and of for in on at to m s ms co by with from as is or into near opp behind".split(),
    "serve": "the a an and of for in on at to m s ms co by with from as is or into near opp behind de des du la le les et en au aux sur dans par pour".split(),
    "fast": "the a an and of for in on at to co inc llc ltd pvt corp corporation limited private company group holdings services solutions enterprises".split(),
}
STOPWORDS["train"] = STOPWORDS["serve"]
STOPWORDS["early"] = "the a an and of for in on at to by with from m s ms co".split()
PREFIXES = {
    "early": "dr shri smt m/s ms mr mrs shree sri prof messrs c/o d/o s/o w/o md ca adv formerly aka a/k/a fka f/k/a dba d/b/a".split(),
    "v1": "dr shri smt m/s ms mr mrs shree sri prof messrs c/o d/o s/o w/o md ca adv".split(),
    "serve": "dr doctor shri smt m/s ms mr mrs shree sri prof professor messrs c/o d/o s/o w/o md ca adv me maitre docteur monsieur madame".split(),
}
PREFIXES["train"] = PREFIXES["serve"]
SUFFIXES = {
    "early": (
        "inc incorporated llc ltd limited corp corporation pvt private enterprises enterprise company group holdings holding services solutions associates associate technologies tech sarl sa gmbh llp pllc co sons "
        "industries industry intl international corp. inc. ltd."
    ).split(),
    "base": "inc llc corp corporation ltd limited pvt private enterprises enterprise company group holdings services solutions associates technologies tech sarl sa gmbh llp".split(),
    "v1": "inc incorporated llc corp corporation ltd limited pvt private enterprises enterprise company group holdings services solutions associates technologies tech sarl sa gmbh llp pllc co sons".split(),
    "serve": "inc incorporated llc corp corporation ltd limited pvt private enterprises enterprise company group holdings services solutions associates technologies tech sarl sa sasu eurl sci snc gmbh llp pllc co sons".split(),
    "train": (
        "inc incorporated llc corp corporation ltd limited enterprises enterprise company group holdings services solutions associates technologies tech llp pllc gmbh co sons "
        "pvt private proprietorship firm trust sarl sas sa sasu eurl sci snc gie sca scs selarl earl scp association ets etablissements"
    ).split(),
}
GENERIC_ADDRESS = {
    "early": (
        "st street rd road ave avenue dr drive blvd lane ln hwy highway po box apt unit floor fl suite ste near opp opposite behind dist district null no door room flat plot bldg building "
        "main cross 1st 2nd 3rd 4th block sector phase"
    ).split(),
    "base": "st street rd road ave avenue dr drive blvd lane ln hwy po box apt unit floor fl suite ste near opp opposite behind dist district null no".split(),
    "v1": "st street rd road ave avenue dr drive blvd lane ln hwy highway po box apt unit floor fl suite ste near opp opposite behind dist district null no door room flat plot bldg building".split(),
    "serve": (
        "st street rd road ave avenue dr drive blvd lane ln hwy highway po box apt unit floor fl suite ste near opp opposite behind dist district null no door room flat plot bldg building "
        "r rue bd bvd boulevard imp impasse all allee chem chemin rte route crs cours res residence cedex"
    ).split(),
    "train": (
        "street road avenue drive boulevard lane highway place square apartment suite building floor district null no door room flat plot rue impasse allee chemin route cours residence batiment etage "
        "cedex near opp opposite behind"
    ).split(),
}
ABBREVIATIONS = {
    "serve": dict(
        x.split(":")
        for x in "st:street rd:road ave:avenue av:avenue dr:drive blvd:boulevard bd:boulevard ln:lane hwy:highway r:rue imp:impasse all:allee chem:chemin rte:route crs:cours res:residence bat:batiment etg:etage cdx:cedex".split()
    ),
    "train": dict(
        x.split(":")
        for x in (
            "st:street rd:road ave:avenue av:avenue dr:drive blvd:boulevard bd:boulevard ln:lane hwy:highway pkwy:parkway pl:place sq:square apt:apartment ste:suite bldg:building fl:floor dist:district "
            "r:rue imp:impasse all:allee chem:chemin rte:route crs:cours res:residence bat:batiment etg:etage bp:boitepostale cdx:cedex"
        ).split()
    ),
}
DOMAIN_ENDS = "com org net in co info biz edu gov io ai tech me tv us de fr uk ca au eu".split()
DOMAIN_ENDS_EARLY = "com org net in co info biz edu gov io ai tech me tv us de fr uk ca au co.in org.in net.in ac.in".split()
ADDRESS_PREFIX = r"\b(?:door\s*no|building\s*no|flat\s*no|room\s*no|plot\s*no|house\s*no|h\.?no|kh\.?no|survey\s*no|pl\s*no|ward\s*no|unit\s*no|fl|floor|block|sector|no|flat|unit|suite|ste)\b\.?\s*[:#]?"
ADDRESS_PREFIX_FRENCH = ADDRESS_PREFIX.replace("suite|ste)", "suite|ste|batiment|bat|etage|porte|numero|num|n°)")
FORMER_NAME = r"(?:formerly|aka|a/k/a|fka|f/k/a|dba|d/b/a|trading\s*as|t/a|nom\s*commercial)[:\s]+(.*)"
OCR_FROM, OCR_TO = "01358@$", "olesbas"

CATEGORIES = (
    ("food_dining", "cafe coffee tea restaurant hotel bakery bakers sweets dhaba kitchen caterers foods bar grill bistro eatery canteen boulangerie resto"),
    ("retail_shop", "shop store bazaar mart supermarket retail kirana provisions traders trading boutique fashion garments footwear appliances jewellers jewellery stationery opticals magasin"),
    ("corporate_tech", "technologies tech infotech software solutions systems consulting services digital labs networks innovations media communications analytics"),
    ("real_estate_premises", "estates properties builders constructions developers realty housing apartments towers complex residency plaza enclave immobiliere batiment"),
    ("healthcare_pharma", "hospital clinic pharma pharmaceuticals healthcare medical diagnostics care dental ayur therapeutics drugs pharmacie clinique"),
    ("industrial_manufacturing", "industries manufacturing works engineering mills textiles chemicals steel metals plastics packaging fabrication motors usine"),
    ("agro_farming", "agro farms farmers fertilizers seeds plantation poultry fisheries dairies milk kisan krishi agricole"),
    ("automotive_transport", "motors automobiles auto logistics transports carriers roadways express garage tyres transport"),
)
DEFAULT_CATEGORY = "commercial_services"
LANDMARK = r"\b(?:near|opp|opposite|behind|b/h|beside|adjacent|next to|près de|face à|en face)\s+([^,]+)"
BUILDING = r"\b(?:plot|no\.?|house|h\.?no|door|flat|suite|apt|ste|unit|\d+[a-z]?)\s*[:#]?\s*([0-9a-z/-]+)"

TYPOS = dict(
    x.split(":")
    for x in (
        "restarant:restaurant restuarant:restaurant resturant:restaurant restraunt:restaurant hotal:hotel colege:college clg:college medicls:medicals chemst:chemist shope:shop gandhipurm:gandhipuram "
        "coimbator:coimbatore banglore:bangalore cheenai:chennai"
    ).split()
)
MARKERS = (
    ("en", r"\b(?:near|nearby|close to|next to|beside|opposite|opp\.?|behind|in front of|at|around)\b"),
    ("en", r"\b(?:facing|adjacent to|cross from)\b"),
    ("ta", "(?:பக்கத்துல|அருகில்|அருகே|எதிரில்|எதிரே|பின்னாடி|பின்புறம்|முன்னாடி|அருகில)"),
    ("ta", "(?:கிட்ட|பக்கம்)"),
    ("hi", "(?:के पास|पास|के सामने|सामने|के पीछे|पीछे|के बगल में|बगल में)"),
    ("fr", r"\b(?:près de|proche de|à côté de|en face de|derrière|devant)\b"),
)
QUERY_CATEGORIES = (
    ("food_dining", "restaurant hotel cafe tea coffee bakery sweets tiffin mess bhojanalaya dhaba food snacks bar bistrot boulangerie சாப்பாடு உணவகம் ஹோட்டல் டீ காபி பேக்கரி சாப்பாட்டு खाना होटल रेस्तरां चाय कॉफ़ी मिठाई ढाबा"),
    ("healthcare", "pharmacy medical medicals chemist clinic hospital pharma lab diagnostic doctor health care pharmacie மருந்தகம் மருத்துவமனை கிளினிக் டாக்டர் மருந்து दवा फार्मेसी अस्पताल क्लीनिक डॉक्टर औषधालय"),
    ("education", "college school university institute academy classes vidyalaya ecole universite lycee கல்லூரி பள்ளி பல்கலைக்கழகம் கல்வி कॉलेज स्कूल विश्वविद्यालय संस्थान विद्यालय"),
    ("retail_grocery", "supermarket store mart provisions groceries textiles silks departmental magasin marche மளிகை கடை அங்காடி துணிக்கடை ஸ்டோர் किराना दुकान बाजार स्टोर वस्त्र"),
    ("automotive_services", "motors garage service auto puncture tyres fuels petrol வண்டி பட்டறை மோட்டார் मोटर गैराज सर्विस पेट्रोल"),
)
COLLOQUIAL = {
    "tamil": (("சாப்பாடு", "restaurant food"), ("நல்ல சாப்பாடு", "quality restaurant meals"), ("கல்லூரி", "college institute"), ("பள்ளி", "school"), ("மருந்தகம்", "pharmacy medicals"), ("மருத்துவமனை", "hospital healthcare"), ("டீ", "tea shop cafe"), ("காபி", "coffee cafe"), ("கடை", "store shop")),
    "hindi": (("खाना", "food restaurant"), ("चाय", "tea stall cafe"), ("दवा", "medical pharmacy"), ("अस्पताल", "hospital clinic"), ("दुकान", "store shop")),
}
# Fixed values. Place -> latitude, longitude; the first place whose name an address contains wins.
PLACES = (
    ("mumbai", 19.0760, 72.8777), ("delhi", 28.6139, 77.2090), ("new delhi", 28.6139, 77.2090), ("bengaluru", 12.9716, 77.5946), ("bangalore", 12.9716, 77.5946), ("hyderabad", 17.3850, 78.4867),
    ("ahmedabad", 23.0225, 72.5714), ("chennai", 13.0827, 80.2707), ("kolkata", 22.5726, 88.3639), ("surat", 21.1702, 72.8311), ("pune", 18.5204, 73.8567), ("jaipur", 26.9124, 75.7873),
    ("coimbatore", 11.0168, 76.9558), ("lucknow", 26.8467, 80.9462), ("kanpur", 26.4499, 80.3319), ("nagpur", 21.1458, 79.0882), ("indore", 22.7196, 75.8577), ("bhopal", 23.2599, 77.4126),
    ("patna", 25.5941, 85.1376), ("vadodara", 22.3072, 73.1812), ("ghaziabad", 28.6692, 77.4538), ("ludhiana", 30.9010, 75.8573), ("agra", 27.1767, 78.0081), ("nashik", 19.9975, 73.7898),
    ("ranchi", 23.3441, 85.3096), ("faridabad", 28.4089, 77.3178), ("meerut", 28.9845, 77.7064), ("rajkot", 22.3039, 70.8022), ("varanasi", 25.3176, 82.9739), ("srinagar", 34.0837, 74.7973),
    ("aurangabad", 19.8762, 75.3433), ("dhanbad", 23.7957, 86.4304), ("amritsar", 31.6340, 74.8723), ("navi mumbai", 19.0330, 73.0297), ("allahabad", 25.4358, 81.8463), ("howrah", 22.5958, 88.2636),
    ("gwalior", 26.2183, 78.1828), ("jabalpur", 23.1815, 79.9864), ("vijayawada", 16.5062, 80.6480), ("jodhpur", 26.2389, 73.0243), ("madurai", 9.9252, 78.1198), ("raipur", 21.2514, 81.6296),
    ("chandigarh", 30.7333, 76.7794), ("guwahati", 26.1445, 91.7362), ("solapur", 17.6599, 75.9064), ("hubli", 15.3647, 75.1240), ("mysore", 12.2958, 76.6394), ("tiruchirappalli", 10.7905, 78.7047),
    ("bareilly", 28.3670, 79.4304), ("aligarh", 27.8974, 78.0880), ("tiruppur", 11.1085, 77.3411), ("moradabad", 28.8386, 78.7733), ("jalandhar", 31.3260, 75.5762), ("bhubaneswar", 20.2961, 85.8245),
    ("salem", 11.6643, 78.1460), ("warangal", 17.9689, 79.5941), ("kerala", 10.8505, 76.2711), ("odisha", 20.9517, 85.0985), ("punjab", 31.1471, 75.3412), ("haryana", 29.0588, 76.0856),
    ("gujarat", 22.2587, 71.1924), ("maharashtra", 19.7515, 75.7139), ("rajasthan", 27.0238, 74.2179), ("tamil nadu", 11.1271, 78.6569), ("karnataka", 15.3173, 75.7139), ("uttar pradesh", 26.8467, 80.9462),
    ("west bengal", 22.9868, 87.8550), ("new york", 40.7128, -74.0060), ("los angeles", 34.0522, -118.2437), ("chicago", 41.8781, -87.6298), ("houston", 29.7604, -95.3698), ("phoenix", 33.4484, -112.0740),
    ("philadelphia", 39.9526, -75.1652), ("san antonio", 29.4241, -98.4936), ("san diego", 32.7157, -117.1611), ("dallas", 32.7767, -96.7970), ("austin", 30.2672, -97.7431), ("san jose", 37.3382, -121.8863),
    ("seattle", 47.6062, -122.3321), ("denver", 39.7392, -104.9903), ("boston", 42.3601, -71.0589), ("atlanta", 33.7490, -84.3880), ("tyler", 32.3513, -95.3011), ("issaquah", 47.5301, -122.0326),
    ("greenburgh", 41.0423, -73.8182), ("pelican rapids", 46.5702, -96.0845), ("murfreesboro", 35.8456, -86.3903), ("jackson", 35.6145, -88.8139), ("iowa city", 41.6611, -91.5302), ("danville", 37.6456, -84.7722),
    ("frederick", 39.4143, -77.4105), ("ayden", 35.4727, -77.4208), ("teachey", 34.7668, -77.9942), ("vincent", 33.3837, -86.4111), ("nantucket", 41.2835, -70.0995), ("brownsville", 25.9017, -97.4975),
    ("schleswig", 42.1647, -95.4372), ("paris", 48.8566, 2.3522), ("marseille", 43.2965, 5.3698), ("lyon", 45.7640, 4.8357), ("toulouse", 43.6047, 1.4442), ("nice", 43.7102, 7.2620),
    ("nantes", 47.2184, -1.5536), ("strasbourg", 48.5734, 7.7521), ("montpellier", 43.6108, 3.8767), ("bordeaux", 44.8378, -0.5792), ("lille", 50.6292, 3.0573), ("rennes", 48.1173, -1.6778),
    ("reims", 49.2583, 4.0317), ("saint-etienne", 45.4397, 4.3872), ("toulon", 43.1242, 5.9280), ("le havre", 49.4944, 0.1079), ("grenoble", 45.1885, 5.7245), ("dijon", 47.3220, 5.0415),
    ("angers", 47.4784, -0.5632), ("nimes", 43.8367, 4.3601), ("dunkerque", 51.0343, 2.3768), ("la teste-de-buch", 44.6300, -1.1444), ("pornic", 47.1147, -2.1028), ("hauts-de-france", 50.4801, 2.7937),
    ("nouvelle-aquitaine", 45.2444, 0.1772),
)
COUNTRY_CENTRES = (("India", 20.5937, 78.9629), ("US", 37.0902, -95.7129), ("France", 46.2276, 2.2137))

