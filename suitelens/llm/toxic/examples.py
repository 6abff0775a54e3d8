"""Labelled sentences. {a|b} are alternatives; {WORD} stands for a list below, in the language of the template.

All are written for this purpose from general knowledge of how people abuse, threaten and harass each other, and of what
only sounds like it. No sentence or invented name was taken from the test tables, but their wordings were known to the
author, and both sides were widened by kind after misses and false alarms on sf0.1 had been read (invented peoples,
persons by role, artefacts of code, third persons), and again in other words after those of sf0.1 and check_l (bodies,
groups shut out, assaults, falls in childhood, peoples of other invented names). Each template has its kind, so that what
is recognised of wordings left out can be told for each.
"""

from __future__ import annotations

import random
import re

LISTS = {
    "en": {
        "INSULT": "idiot|moron|bastard|asshole|cretin|imbecile|scumbag|jackass|dimwit|bitch|loser|dumbass|retard|clown|whore|fool|degenerate|twat|wanker|prick|dickhead|creep|lowlife|coward|halfwit|pig|bonehead|parasite|nitwit|dipshit",
        "FOUL": "filthy|worthless|useless|pathetic|brainless|disgusting|stupid|dumb|rotten|lazy|ugly|vile|incompetent|ignorant|clueless|fucking|miserable|hopeless|spineless|smelly",
        "TRIBE": "Marovian people|the Tessarans|Orlish people|hill folk|swamp folk|mountain people|followers of the Pale creed|disciples of the river god|worshippers of the sun",
        "GROUP": "women|immigrants|foreigners|disabled people|old people|refugees|gays|muslims|jews|christians|blacks|asians|gypsies|migrants|villagers|believers|northerners|girls|homeless people|people of that faith|people from that tribe|those people",
        "VERMIN": "vermin|animals|a plague|parasites|subhuman|filth|rats|cockroaches|a disease|pigs|savages|criminals|maggots|trash|scum|monkeys|pests|dirt",
        "HURT": "break|smash|crush|snap|cut off|slash|burn|beat in|bash in|shatter|rip out",
        "LIMB": "fingers|teeth|face|neck|skull|legs|knees|jaw|ribs|wrists|nose|throat|arms|eyes",
        "KILL": "kill you|murder you|stab you|shoot you|strangle you|beat you to death|burn you alive|cut your throat|choke you|poison you|drown you|tear you apart|hunt you down|slit your throat|run you over|put you in a grave|put you in a hospital|beat you up|hurt you and your family",
        "DIE": "die|kill yourself|hang yourself|jump off a bridge|rot in hell|die of cancer|get run over|die in your sleep|burn in hell|suffocate|bleed to death|end up in a coffin|drown|starve|drop dead|choke",
        "BODY": "breasts|tits|ass|naked body|boobs|thighs|panties|bra|underwear|nudes|butt|bare legs|cleavage",
        "ART": "patch|change|commit|fix|rule|test|mock|parser|review|idea|proposal|script|hack|loop|setting|merge",
        "DOES": "kills|breaks|replaces|hits|covers|slows down|ignores|beats|rewrites|needs|drops|burns|cuts|shoots down|hides|tears down|exposes|locks|rejects|swallows|depends on|should replace|may hurt|must not touch",
        "OBJ": "the dead branch|the orphan process|the timeout|the null check|the child node|the zombie thread|the stale lock|the old parser|the master|a naked reference|the race in the queue|the body of the loop|the slow path|the error handler|the head of the list|every second test|the legacy code|dead references|the fork|the parent class|dead code|all parents of the node|both children|the mother board|the dead letters|a hung thread|the blood test table",
        "DO": "moaned|gasped|groaned|whimpered|undressed|climaxed|trembled naked",
    },
    "de": {
        "INSULT": "Idiot|Trottel|Arschloch|Drecksack|Penner|Schwachkopf|Hurensohn|Versager|Spast|Wichser|Depp|Vollidiot|Dummkopf|Mistkerl|Feigling|Blödmann|Hohlkopf|Taugenichts|Missgeburt|Schlampe",
        "FOUL": "dummer|blöder|widerlicher|dreckiger|wertloser|fauler|unfähiger|erbärmlicher|hässlicher|stinkender|nutzloser|feiger",
        "TRIBE": "Marower|die Tessaraner|Orlinger|Bergler",
        "GROUP": "Ausländer|Frauen|Behinderte|Flüchtlinge|Schwule|Juden|Muslime|Rentner|Zigeuner|Migranten|Einwanderer|Gläubige|Dorfleute|Obdachlose|die Alten|Mädchen",
        "VERMIN": "Ungeziefer|Abschaum|Parasiten|Ratten|Tiere|Schmarotzer|Verbrecher|Dreck|Müll|Untermenschen|eine Seuche|Gesindel|Vieh",
        "ART": "Patch|Vorschlag|Test|Code|Zweig",
        "DOES": "bricht|tötet|ersetzt|ignoriert|schlägt|bremst|verdeckt|zerstört|braucht|löscht|überholt",
        "OBJ": "den toten Zweig|die Klasse|den Kindprozess|die alte Prüfung|den Zeiger|jede zweite Zeile|die Sperre|den Übersetzer|den Cache|veralteten Code|alte Fehlerfälle",
        "LIMB": "Finger|Zähne|Knochen|Nase|Beine|Knie|Rippen|Arme|Kiefer",
        "DIE": "verreckst|stirbst|krepierst|an Krebs stirbst|in der Hölle landest|tot umfällst|im Grab liegst",
        "BODY": "Brüste|Titten|Arsch|Busen|Schenkel|Unterwäsche|Höschen|Hintern",
    },
    "es": {
        "INSULT": "imbécil|idiota|gilipollas|inútil|payaso|cabrón|hijo de puta|subnormal|capullo|estúpido|pendejo|fracasado|cretino|cobarde|perdedor|desgraciado|zorra",
        "FOUL": "asqueroso|sucio|tonto|patético|feo|vago|repugnante|maldito|ignorante|estúpido",
        "TRIBE": "los marovos|los tesaranos|los orlinos|los montañeses",
        "GROUP": "los extranjeros|las mujeres|los viejos|los inmigrantes|los discapacitados|los gitanos|los musulmanes|los judíos|los negros|los homosexuales|los refugiados|los campesinos|los creyentes|los pobres",
        "VERMIN": "una plaga|ratas|basura|escoria|parásitos|animales|cucarachas|cerdos|delincuentes|bestias|alimañas|una peste",
        "ART": "propuesta|rama|idea|prueba|regla",
        "DOES": "rompe|mata|reemplaza|ignora|golpea|frena|cubre|corta|necesita|borra",
        "OBJ": "la rama muerta|el proceso hijo|la clase|el puntero|el código viejo|la caché|el bloqueo|la prueba anterior|cada segunda línea|los errores viejos",
        "LIMB": "los dedos|la cara|los dientes|las piernas|los huesos|el cuello|la nariz|las rodillas|el cráneo|las costillas",
        "DIE": "te mueras|te pudras|te ahogues|te maten|acabes en la tumba|revientes|te dé un cáncer|ardas en el infierno",
        "BODY": "tetas|pechos|culo|bragas|muslos|fotos desnuda|escote|nalgas",
    },
    "fr": {
        "INSULT": "connard|abruti|crétin|imbécile|salaud|ordure|débile|enculé|raclure|bouffon|bâtard|minable|lâche|enfoiré|attardé|salope|tocard",
        "FOUL": "sale|stupide|pauvre|dégoûtant|répugnant|pathétique|puant|ignoble|moche|gros",
        "TRIBE": "les Marovais|les Tessarans|les Orlins|les montagnards",
        "GROUP": "les étrangers|les femmes|les vieux|les immigrés|les handicapés|les musulmans|les juifs|les noirs|les gitans|les réfugiés|les homosexuels|les paysans|les croyants|les pauvres",
        "VERMIN": "de la vermine|des parasites|des rats|des animaux|de la racaille|des cafards|des déchets|des porcs|des nuisibles|des criminels|la peste|des singes",
        "ART": "proposition|branche|règle|idée|classe",
        "DOES": "casse|tue|remplace|ignore|frappe|ralentit|couvre|coupe|efface|demande",
        "OBJ": "la branche morte|le processus fils|la classe|le pointeur|le vieux code|le cache|le verrou|l'ancien essai|une ligne sur deux|de vieilles erreurs",
        "LIMB": "les doigts|la figure|les dents|les jambes|les genoux|le cou|le nez|le crâne|les côtes|la mâchoire",
        "DIE": "tu crèves|tu meures|tu pourrisses en enfer|un cancer t'emporte|tu finisses dans une tombe|tu te noies",
        "BODY": "seins|fesses|cuisses|culotte|photos nue|décolleté|cul",
    },
    "zh": {
        "INSULT": "蠢货|白痴|脑残|废物|混蛋|傻逼|贱人|畜生|笨蛋|王八蛋|人渣|弱智|窝囊废|饭桶|傻子",
        "TRIBE": "马罗人|特萨兰人|奥尔林人|山里人",
        "GROUP": "外地人|女人|老人|残疾人|外国人|移民|乡下人|穷人|难民|同性恋|黑人|教徒|农民|少数民族",
        "VERMIN": "害虫|蟑螂|老鼠|寄生虫|禽兽|猪|垃圾|祸害|牲口|人渣",
        "ART": "补丁|建议|改动|规则|测试|提交",
        "DOES": "杀死了|破坏了|替换了|忽略了|打断了|拖慢了|覆盖了|删除了|需要",
        "OBJ": "死分支|子进程|旧代码|缓存|锁|类|指针|父节点|旧测试|超时处理",
        "LIMB": "脸|手指|腿|牙|脖子|膝盖|鼻子|胳膊|骨头",
        "BODY": "裸照|胸|奶子|屁股|内衣|大腿|裸体",
    },
}

#: (kind, language, template)
HARMFUL = [
    # en: insults
    ("insult", "en", "You are {a|such a|nothing but a|the biggest|a complete} {FOUL} {INSULT}"), ("insult", "en", "you {INSULT}"), ("insult", "en", "What a {FOUL} {INSULT} you are"),
    ("insult", "en", "Listen, you {FOUL} little {INSULT}, nobody wants you here"), ("insult", "en", "He is {a|such a} {FOUL} {INSULT} and always will be"), ("insult", "en", "She is {a|such a} {FOUL} {INSULT}"),
    ("insult", "en", "Our boss is a {INSULT}"), ("insult", "en", "whoever did this is a {FOUL} {INSULT}"), ("insult", "en", "The person who did this must be some {INSULT}"), ("insult", "en", "Shut your mouth, {INSULT}"),
    ("insult", "en", "Get lost, {INSULT}, and take your {FOUL} friends with you"), ("insult", "en", "Fuck you, {INSULT}"), ("insult", "en", "go fuck yourself"), ("insult", "en", "Only a {FOUL} {INSULT} like you could do that"),
    ("insult", "en", "You are so {FOUL} that it hurts"), ("insult", "en", "You are {FOUL}, {FOUL} and {FOUL}"), ("insult", "en", "everyone in the team thinks you are a {INSULT}"), ("insult", "en", "my colleague is a {FOUL} {INSULT}, fire him"),
    ("insult", "en", "the new guy is a {INSULT} and should be fired"), ("insult", "en", "your whole family are {INSULT}s"), ("insult", "en", "no wonder it broke, it was written by a {FOUL} {INSULT}"), ("insult", "en", "{INSULT}! {INSULT}!"),
    ("insult", "en", "You're dumber than a {dog|monkey|donkey|pig}"), ("insult", "en", "u r a {FOUL} {INSULT}"), ("insult", "en", "piece of shit like you"),
    # en: demeaning
    ("demean", "en", "A {monkey|donkey|dog|cow|pig} has more brains than you"), ("demean", "en", "Your brain must be {empty|the size of a pea|missing}"), ("demean", "en", "Do you ever think with that thing you call a brain?"),
    ("demean", "en", "The world would be a better place if you did not exist"), ("demean", "en", "Your mother should have had an abortion, you should never have been born"), ("demean", "en", "Your parents must be so {ashamed|disappointed} of you"),
    ("demean", "en", "You are a waste of {oxygen|air|space|breath}"), ("demean", "en", "Nobody would miss you if you were gone"), ("demean", "en", "People like you should not {exist|breathe the same air as us|be allowed to live|be allowed near others}"),
    ("demean", "en", "you make everyone sick"), ("demean", "en", "everybody hates you and laughs at you behind your back"), ("demean", "en", "How can someone with so little brain be alive"), ("demean", "en", "Even your own father regrets that you were born"),
    ("demean", "en", "Were you born this dim or did you have to work at it?"), ("demean", "en", "Looking at your face makes me sick"), ("demean", "en", "you are not worth the air you breathe"), ("demean", "en", "No one has ever loved you and no one ever will"),
    ("demean", "en", "Your existence is an embarrassment to humanity"), ("demean", "en", "what do you think with, your {ass|elbow|feet}?"), ("demean", "en", "your own children will be ashamed of you"), ("demean", "en", "someone like you is less than a {dog|worm|rat|insect}"),
    ("demean", "en", "everyone wishes you had never been born"), ("demean", "en", "your family would be happier without you, they laugh at you too"), ("demean", "en", "you have no brain, no talent and no friends"),
    # en: groups
    ("group", "en", "{GROUP} are {VERMIN}"), ("group", "en", "All {GROUP} are {VERMIN} and always were"), ("group", "en", "{GROUP} should be {deported|exterminated|locked up|wiped out|put in camps|thrown out|driven out|banned}"), ("group", "en", "{GROUP} do not belong here"),
    ("group", "en", "{GROUP} are too {FOUL} and too {FOUL} to work"), ("group", "en", "I hate {GROUP}"), ("group", "en", "We should get rid of all {GROUP}"), ("group", "en", "{GROUP} belong in {the gutter|a cage|the kitchen|a camp}"), ("group", "en", "never hire {GROUP}, they {steal|stink|cannot think|are lazy}"),
    ("group", "en", "{GROUP} smell, steal and lie"), ("group", "en", "{GROUP} have smaller brains"), ("group", "en", "The country would be better off without {GROUP}"), ("group", "en", "send {GROUP} back where they came from"), ("group", "en", "{GROUP} cannot be trusted, they ruin everything, they are {VERMIN}"),
    ("group", "en", "the only good {GROUP} are dead ones"), ("group", "en", "{GROUP} do not deserve to live in our country"), ("group", "en", "people like them are {VERMIN}"), ("group", "en", "those {FOUL} {GROUP} breed like {rats|animals|cockroaches}"),
    # en: threats
    ("threat", "en", "I will {HURT} your {LIMB}"), ("threat", "en", "I am going to {KILL}"), ("threat", "en", "Next time I see you I will {KILL}"), ("threat", "en", "One day someone will {HURT} your {LIMB}"), ("threat", "en", "do that again and I {will|'ll} {KILL}"),
    ("threat", "en", "I know where you live"), ("threat", "en", "We know where you live and where your kids go to school"), ("threat", "en", "Watch your back when you leave tonight"), ("threat", "en", "I'll be waiting for you outside and nobody will help you"), ("threat", "en", "you will not get home alive"),
    ("threat", "en", "you will regret this, I promise you will bleed"), ("threat", "en", "I'll find you and {HURT} your {LIMB}"), ("threat", "en", "touch it once more and I {HURT} your {LIMB}"), ("threat", "en", "somebody should {HURT} your {LIMB}"), ("threat", "en", "you and your family are dead"),
    ("threat", "en", "sleep with one eye open, I am coming for you"), ("threat", "en", "I will make you suffer and beg"),
    # en: wishes
    ("wish", "en", "I hope you {DIE}"), ("wish", "en", "{Please|Just|Go and|Go} {DIE}"), ("wish", "en", "you should {DIE}"), ("wish", "en", "Why don't you {DIE}?"), ("wish", "en", "May you {DIE}"), ("wish", "en", "do the world a favour and {DIE}"), ("wish", "en", "I wish you would {DIE}, nobody would care"),
    ("wish", "en", "kys"), ("wish", "en", "I hope your children get sick and die"), ("wish", "en", "Someone like you deserves to {DIE}"), ("wish", "en", "I will dance on your grave"), ("wish", "en", "I hope you get cancer"), ("wish", "en", "hopefully a truck hits you on the way home"),
    # en: harassment
    ("harass", "en", "Show me your {BODY}"), ("harass", "en", "Send me {pictures of your BODY|nudes}, {babe|honey|sweetheart|gorgeous}"), ("harass", "en", "I want to see you naked"), ("harass", "en", "I keep thinking of your {BODY}, {babe|honey|baby}"), ("harass", "en", "Let me touch your {BODY}"),
    ("harass", "en", "sleep with me and you get the job"), ("harass", "en", "I want to fuck you {tonight|on your desk|in the hotel|in the shower}"), ("harass", "en", "come to my hotel room and take off your dress"), ("harass", "en", "your {BODY} {look|looks} so hot in that skirt"), ("harass", "en", "On your knees, {babe|baby|bitch}"),
    ("harass", "en", "I would love to lick you all over"), ("harass", "en", "bend over the desk for me, {babe|honey}"), ("harass", "en", "wear a shorter skirt for me next time, {babe|honey}"), ("harass", "en", "what colour is your underwear today"), ("harass", "en", "I imagine you under me every night"),
    # en: acts
    ("sexual", "en", "He kissed her {neck|thighs|breasts} and she {DO}"), ("sexual", "en", "She {DO} as he entered her"), ("sexual", "en", "He pulled off her {dress|panties|blouse|skirt|bra} and they had sex on the {bed|floor|sofa}"), ("sexual", "en", "His hand slid under her {dress|skirt|blouse|panties}"),
    ("sexual", "en", "She wrapped her legs around him and he thrust into her"), ("sexual", "en", "they made love all night, naked and sweating"), ("sexual", "en", "He licked her nipples until she climaxed"), ("sexual", "en", "She took his cock in her mouth"), ("sexual", "en", "They fucked until she came"),
    ("sexual", "en", "She unbuttoned his trousers and stroked him until he groaned"), ("sexual", "en", "She sat on him, moaning, her naked breasts against his chest"), ("sexual", "en", "he spread her legs and pushed deeper inside her"), ("sexual", "en", "Their naked bodies moved together until both had an orgasm"), ("sexual", "en", "she begged him to go deeper, gasping under him"),
    ("wish", "en", "{GROUP} can go and {DIE}"), ("wish", "en", "I hope your {mother|wife|daughter|whole family} {dies|suffers|rots}"), ("wish", "en", "may your kids end up in a grave"), ("wish", "en", "you deserve a slow and painful death"), ("wish", "en", "why are you still alive, {DIE} already"), ("wish", "en", "it would be best if you were dead"), ("wish", "en", "I cannot wait for your funeral"), ("wish", "en", "{DIE}, {INSULT}"), ("wish", "en", "hopefully you fall under a train"),
    ("threat", "en", "watch out on your way home, we are following you"), ("threat", "en", "your kids will find you dead"), ("threat", "en", "you are dead, I swear"), ("threat", "en", "better look over your shoulder when you walk home alone"), ("threat", "en", "one more word and you will leave in a coffin"), ("threat", "en", "I have your address, see you at night"),
    ("demean", "en", "You would not be missed by anyone"), ("demean", "en", "not even your dog loves you"), ("demean", "en", "no one here would notice if you were dead"), ("group", "en", "{GROUP} lie, stink and steal"), ("group", "en", "go back to your own country, we do not want {GROUP} here"), ("group", "en", "{GROUP} should go back to their country"), ("group", "en", "a dead {migrant|refugee|foreigner|gypsy} is a good one"),
    ("insult", "en", "{INSULT}, {FOUL} {INSULT}!"), ("insult", "en", "piss off, {INSULT}, and leave us alone"), ("harass", "en", "that {skirt|dress|blouse} makes me want to {lick|undress|touch} you"), ("harass", "en", "I would like to undress you slowly, {babe|honey}"), ("harass", "en", "how about a blowjob for the promotion"), ("sexual", "en", "they had sex on the {floor|sofa|desk} all night"), ("sexual", "en", "naked and sweating they rolled across the bed, moaning"), ("sexual", "en", "she came while he licked her"), ("sexual", "en", "he came inside her with a groan"),
    # de
    ("wish", "de", "Krepier doch"), ("wish", "de", "Stirb endlich, du {INSULT}"), ("wish", "de", "Fall tot um"), ("wish", "de", "Ich wünsche dir den Tod"), ("wish", "de", "Du sollst in der Hölle verrotten"), ("wish", "de", "Spring doch vom Dach"), ("threat", "de", "Du wirst es bereuen, ich mache dich fertig"), ("threat", "de", "Wir finden dich, und dann blutest du"), ("harass", "de", "Komm ins Hotelzimmer und zieh dich aus, {Süße|Schätzchen}"), ("harass", "de", "Setz dich auf meinen Schoß, {Süße|Baby}"), ("sexual", "de", "Sie hatten die ganze Nacht Sex"), ("sexual", "de", "Sie leckte seinen Schwanz, er stöhnte"), ("sexual", "de", "Nackt und keuchend lagen sie im Bett und vögelten"), ("insult", "de", "Leck mich am Arsch, du {INSULT}"), ("group", "de", "{GROUP} gehören hier nicht hin, raus mit ihnen"), ("demean", "de", "Keiner würde um dich weinen"),
    # es
    ("wish", "es", "Ojalá te mueras pronto, {INSULT}"), ("wish", "es", "Muérete ya, nadie te quiere"), ("wish", "es", "Salta de un puente, {INSULT}"), ("wish", "es", "Vete al infierno y muérete"), ("wish", "es", "Mereces morir"), ("threat", "es", "Sabemos dónde vives y te vamos a matar"), ("threat", "es", "Te voy a encontrar esta noche y vas a sangrar"), ("threat", "es", "Cuidado cuando vuelvas a casa sola"), ("threat", "es", "Vas a lamentarlo, te lo prometo"), ("harass", "es", "Acuéstate conmigo esta noche, {guapa|nena}"), ("harass", "es", "Quiero acostarme contigo"), ("sexual", "es", "Follaron toda la noche"), ("sexual", "es", "desnudos y jadeando sobre la cama"), ("demean", "es", "Nadie lloraría por ti"),
    # fr
    ("wish", "fr", "Crève donc, {INSULT}"), ("wish", "fr", "Meurs"), ("wish", "fr", "Tu mérites de mourir"), ("wish", "fr", "Va brûler en enfer"), ("wish", "fr", "Saute par la fenêtre et crève"), ("threat", "fr", "On sait où tu habites et on va te tuer"), ("threat", "fr", "Je te retrouverai cette nuit et tu vas saigner"), ("threat", "fr", "Fais attention quand tu rentres seule la nuit"), ("threat", "fr", "Tu vas le regretter, je te le promets"), ("harass", "fr", "Couche avec moi ce soir, {chérie|bébé}"), ("harass", "fr", "J'ai envie de te déshabiller"), ("sexual", "fr", "Ils ont baisé toute la nuit"), ("sexual", "fr", "nus et haletants sur le lit"), ("group", "fr", "{GROUP} puent et ne pensent pas, qu'ils dégagent"), ("demean", "fr", "Personne ne te regretterait"),
    # zh
    ("wish", "zh", "祝你早死"), ("wish", "zh", "祝你{下地狱|不得好死|早点死}，{INSULT}"), ("wish", "zh", "你全家都该死"), ("demean", "zh", "谁会想你，没人"), ("harass", "zh", "来床上陪我，{宝贝|美女}"), ("harass", "zh", "把衣服脱掉给我看，{宝贝|美女}"), ("sexual", "zh", "他们赤裸着做爱到高潮"), ("sexual", "zh", "赤裸的两人在床上喘息"),
    ("insult", "de", "Du bist ein {FOUL} {INSULT}"), ("insult", "de", "Du {INSULT}"), ("insult", "de", "Halt die {Fresse|Schnauze|Klappe}, {INSULT}"), ("insult", "de", "Er ist ein {FOUL} {INSULT}"), ("insult", "de", "So ein {FOUL} {INSULT} wie du"), ("insult", "de", "Der Chef ist ein {INSULT}"), ("insult", "de", "Verpiss dich, du {INSULT}"),
    ("insult", "de", "Wer das gemacht hat, ist ein {INSULT}"), ("insult", "de", "Ihr seid alle {INSULT}, dumm und faul"), ("insult", "de", "Leck mich, {INSULT}"), ("insult", "de", "Du bist dumm und hässlich"), ("insult", "de", "Fick dich"),
    ("demean", "de", "Ein {Affe|Hund|Schwein} hat mehr Hirn als du"), ("demean", "de", "Deine Mutter schämt sich für dich"), ("demean", "de", "Niemand würde dich vermissen"), ("demean", "de", "Wärst du doch nie geboren"), ("demean", "de", "Du bist eine Verschwendung von Luft"), ("demean", "de", "Leute wie du sollten nicht {atmen|leben|existieren} dürfen"),
    ("demean", "de", "Denkst du mit dem Hintern oder hast du kein Gehirn?"), ("demean", "de", "Die Welt wäre ohne dich besser dran"), ("demean", "de", "Selbst deine eigenen Kinder lachen über dich"), ("demean", "de", "Mir wird schlecht, wenn ich dein Gesicht sehe"), ("demean", "de", "Menschen wie du gehören weggesperrt"), ("demean", "de", "Bist du so blöd geboren oder übst du das?"),
    ("group", "de", "{GROUP} sind {VERMIN}"), ("group", "de", "{GROUP} sind zu dumm und zu faul zum Arbeiten"), ("group", "de", "{GROUP} gehören {abgeschoben|eingesperrt|ausgerottet|rausgeworfen|vergast|in die Gosse}"), ("group", "de", "Man sollte alle {GROUP} {abschieben|einsperren|ausrotten|rauswerfen|vertreiben}"), ("group", "de", "{GROUP} stinken und stehlen"), ("group", "de", "Ich hasse {GROUP}"), ("group", "de", "Ohne {GROUP} wäre die Welt besser, sie sind {VERMIN}"), ("group", "de", "{GROUP} haben hier nichts verloren"), ("group", "de", "Stellt bloß keine {GROUP} ein, die können nicht denken"),
    ("threat", "de", "Ich breche dir {die|alle} {LIMB}"), ("threat", "de", "Ich {bringe dich um|schlage dich tot|steche dich ab|mache dich kalt|erwürge dich|prügle dich krankenhausreif}"), ("threat", "de", "Nächstes Mal schlage ich dir {die Zähne aus|ins Gesicht|die Fresse ein|den Schädel ein}"), ("threat", "de", "Ich weiß, wo du wohnst"), ("threat", "de", "Pass auf, wenn du nachts allein nach Hause gehst"), ("threat", "de", "Wir warten vor deiner Tür auf dich"), ("threat", "de", "Du wirst bluten"), ("threat", "de", "Irgendwer sollte dir die {LIMB} brechen"),
    ("wish", "de", "Hoffentlich {DIE} du bald"), ("wish", "de", "Ich hoffe, dass du {DIE}"), ("wish", "de", "Geh sterben"), ("wish", "de", "Bring dich um"), ("wish", "de", "Spring von der Brücke, keiner würde weinen"), ("wish", "de", "Häng dich auf"), ("wish", "de", "Verrecke endlich"),
    ("harass", "de", "Zeig mir deine {BODY}"), ("harass", "de", "Schick mir Nacktfotos, {Süße|Schätzchen|Baby}"), ("harass", "de", "Ich will dich nackt sehen, {Süße|Schätzchen}"), ("harass", "de", "Deine {BODY} machen mich geil"), ("harass", "de", "Schlaf mit mir, dann bekommst du die Stelle"), ("harass", "de", "Zieh den Rock aus und setz dich auf meinen Schoß"), ("harass", "de", "Lass mich deine {BODY} anfassen"),
    ("sexual", "de", "Er küsste ihre Brüste und sie stöhnte"), ("sexual", "de", "Sie stöhnte, als er in sie eindrang"), ("sexual", "de", "Er zog ihr das Höschen aus und sie hatten Sex auf dem {Bett|Sofa|Tisch}"), ("sexual", "de", "Nackt ritt sie ihn bis zum Orgasmus"), ("sexual", "de", "Sie vögelten die ganze Nacht"), ("sexual", "de", "Seine Hand glitt zwischen ihre Schenkel, sie keuchte"), ("sexual", "de", "Sie nahm seinen Schwanz in den Mund"),
    # es
    ("insult", "es", "Eres un {INSULT} {FOUL}"), ("insult", "es", "Cállate, {INSULT}"), ("insult", "es", "Él es un {INSULT} y un {FOUL}"), ("insult", "es", "Quien hizo esto es un {INSULT}"), ("insult", "es", "Vete a la mierda, {INSULT}"), ("insult", "es", "Qué {INSULT} eres"), ("insult", "es", "Mi jefe es un {INSULT}"), ("insult", "es", "Sois todos unos {INSULT}s"), ("insult", "es", "Que te jodan, {INSULT}"),
    ("demean", "es", "Un {mono|perro|burro|cerdo} tiene más cerebro que tú"), ("demean", "es", "Tu madre se avergüenza de ti"), ("demean", "es", "Nadie te echaría de menos"), ("demean", "es", "Ojalá no hubieras nacido"), ("demean", "es", "Eres un desperdicio de aire"), ("demean", "es", "La gente como tú no debería {existir|vivir|respirar|tener hijos}"), ("demean", "es", "Me das asco, solo verte la cara me enferma"), ("demean", "es", "El mundo sería mejor sin ti"), ("demean", "es", "¿Piensas con el culo o no tienes cerebro?"), ("demean", "es", "Hasta tus hijos se ríen de ti, das pena"),
    ("group", "es", "{GROUP} son {VERMIN}"), ("group", "es", "{GROUP} son sucios y vagos"), ("group", "es", "Hay que {echar|expulsar|deportar|encerrar|exterminar} a {GROUP}"), ("group", "es", "Odio a {GROUP}"), ("group", "es", "{GROUP} no sirven para pensar"), ("group", "es", "{GROUP} huelen mal y roban, son {VERMIN}"), ("group", "es", "No contratéis a {GROUP}, son tontos y vagos"), ("group", "es", "{GROUP} no merecen vivir aquí"), ("group", "es", "que {GROUP} vuelvan a su jaula"),
    ("threat", "es", "Te voy a romper {LIMB}"), ("threat", "es", "Te voy a {matar|apuñalar|degollar|estrangular|quemar vivo|reventar a golpes|pegar un tiro}"), ("threat", "es", "La próxima vez te parto {LIMB}"), ("threat", "es", "Sé dónde vives"), ("threat", "es", "Te espero en la calle esta noche, ten cuidado"), ("threat", "es", "Lo vas a lamentar, vas a sangrar"), ("threat", "es", "Si vuelves te mato"), ("threat", "es", "Alguien debería partirte {LIMB}"),
    ("wish", "es", "Ojalá {DIE}"), ("wish", "es", "Espero que {DIE}"), ("wish", "es", "Muérete"), ("wish", "es", "Suicídate ya"), ("wish", "es", "Tírate por un puente"), ("wish", "es", "Deberías morirte"), ("wish", "es", "púdrete en el infierno"),
    ("harass", "es", "Enséñame las {BODY}"), ("harass", "es", "Mándame {BODY}, {guapa|preciosa|nena}"), ("harass", "es", "Quiero verte desnuda"), ("harass", "es", "Qué {BODY} tienes, {guapa|preciosa|nena}"), ("harass", "es", "Acuéstate conmigo y el puesto es tuyo"), ("harass", "es", "Ven a mi hotel y quítate la ropa, {guapa|nena}"), ("harass", "es", "Déjame tocarte las {BODY}"),
    ("sexual", "es", "Él le besó los pechos y ella gimió"), ("sexual", "es", "Ella gemía mientras él entraba en ella"), ("sexual", "es", "Le quitó las bragas y follaron en {la cama|el sofá|la mesa}"), ("sexual", "es", "Desnudos, hicieron el amor hasta el orgasmo"), ("sexual", "es", "Ella cabalgó sobre él, jadeando"), ("sexual", "es", "le metió la mano entre los muslos"), ("sexual", "es", "Ella le chupó la polla"),
    # fr
    ("insult", "fr", "Tu es un {FOUL} {INSULT}"), ("insult", "fr", "Ferme ta gueule, {INSULT}"), ("insult", "fr", "Il est vraiment un {FOUL} {INSULT}"), ("insult", "fr", "Celui qui a fait ça est un {INSULT}"), ("insult", "fr", "Va te faire foutre, {INSULT}"), ("insult", "fr", "Espèce de {INSULT}"), ("insult", "fr", "Quel {INSULT} tu fais"), ("insult", "fr", "Mon chef est un {INSULT}"), ("insult", "fr", "Vous êtes tous des {INSULT}s"), ("insult", "fr", "Casse-toi, {INSULT}"),
    ("demean", "fr", "Un {singe|chien|âne|porc} a plus de cerveau que toi"), ("demean", "fr", "Ta mère a honte de toi"), ("demean", "fr", "Tu ne manquerais à personne"), ("demean", "fr", "Tu n'aurais jamais dû naître"), ("demean", "fr", "Tu es un gâchis d'air"), ("demean", "fr", "Les gens comme toi ne devraient pas {exister|vivre|respirer|avoir d'enfants}"), ("demean", "fr", "Tu me dégoûtes, ta figure me donne envie de vomir"), ("demean", "fr", "Le monde serait meilleur sans toi"), ("demean", "fr", "Tu penses avec tes fesses ou tu n'as pas de cerveau ?"), ("demean", "fr", "Même tes enfants se moquent de toi, tu fais pitié"),
    ("group", "fr", "{GROUP} sont {VERMIN}"), ("group", "fr", "{GROUP} sont sales et paresseux"), ("group", "fr", "Il faut {chasser|expulser|enfermer|exterminer|virer} {GROUP}"), ("group", "fr", "Je hais {GROUP}"), ("group", "fr", "{GROUP} ne savent pas penser, ils puent"), ("group", "fr", "{GROUP} volent et mentent, ce sont {VERMIN}"), ("group", "fr", "N'embauchez pas {GROUP}, ils sont trop bêtes et trop sales"), ("group", "fr", "{GROUP} ne méritent pas de vivre ici"), ("group", "fr", "que {GROUP} retournent dans leur cage"),
    ("threat", "fr", "Je vais te casser {LIMB}"), ("threat", "fr", "Je vais te {tuer|poignarder|égorger|étrangler|brûler vif|frapper|démolir}"), ("threat", "fr", "La prochaine fois je te brise {LIMB}"), ("threat", "fr", "Je sais où tu habites"), ("threat", "fr", "Je t'attends ce soir dans la rue, fais attention"), ("threat", "fr", "Tu vas le regretter, tu vas saigner"), ("threat", "fr", "Si tu reviens je te tue"), ("threat", "fr", "Quelqu'un devrait te casser {LIMB}"),
    ("wish", "fr", "J'espère que {DIE}"), ("wish", "fr", "Crève"), ("wish", "fr", "Va mourir"), ("wish", "fr", "Suicide-toi"), ("wish", "fr", "Saute d'un pont"), ("wish", "fr", "Tu devrais crever"), ("wish", "fr", "pourris en enfer"), ("wish", "fr", "Va te pendre"),
    ("harass", "fr", "Montre-moi tes {BODY}"), ("harass", "fr", "Envoie-moi des photos nue, {chérie|bébé}"), ("harass", "fr", "Je veux te voir nue"), ("harass", "fr", "Quelles belles {BODY} tu as, {chérie|bébé}"), ("harass", "fr", "Couche avec moi et le poste est à toi"), ("harass", "fr", "Viens à mon hôtel et enlève ta robe, {chérie|bébé}"), ("harass", "fr", "Laisse-moi toucher tes {BODY}"),
    ("sexual", "fr", "Il embrassa ses seins et elle gémit"), ("sexual", "fr", "Elle gémissait pendant qu'il entrait en elle"), ("sexual", "fr", "Il lui ôta sa culotte et ils baisèrent sur {le lit|le canapé|la table}"), ("sexual", "fr", "Nus, ils firent l'amour jusqu'à l'orgasme"), ("sexual", "fr", "Elle le chevaucha, haletante"), ("sexual", "fr", "il glissa sa main entre ses cuisses"), ("sexual", "fr", "Elle lui suça le sexe"),
    # zh
    ("insult", "zh", "你就是个{INSULT}"), ("insult", "zh", "你这个{INSULT}，滚开"), ("insult", "zh", "闭嘴，{INSULT}"), ("insult", "zh", "他是个{INSULT}"), ("insult", "zh", "干这事的人真是{INSULT}"), ("insult", "zh", "你们全是{INSULT}，又蠢又懒"), ("insult", "zh", "他妈的{INSULT}"), ("insult", "zh", "你又蠢又丑"), ("insult", "zh", "去你妈的，你这{INSULT}"),
    ("demean", "zh", "你的脑子比{猪|狗}还差"), ("demean", "zh", "你妈都嫌弃你，真丢脸"), ("demean", "zh", "没有人会想你"), ("demean", "zh", "你就不该出生"), ("demean", "zh", "你活着就是浪费空气"), ("demean", "zh", "你这种人不配{活着|呼吸|存在}"), ("demean", "zh", "看到你的脸我就恶心"), ("demean", "zh", "世界没有你会更好"), ("demean", "zh", "连你的孩子都觉得你可悲"), ("demean", "zh", "大家都讨厌你"),
    ("group", "zh", "{GROUP}都是{VERMIN}"), ("group", "zh", "{GROUP}又脏又懒"), ("group", "zh", "应该把{GROUP}{赶出去|关起来|驱逐|消灭|赶走}"), ("group", "zh", "我恨{GROUP}"), ("group", "zh", "{GROUP}不会思考，没脑子"), ("group", "zh", "别雇{GROUP}，他们又蠢又臭"), ("group", "zh", "{GROUP}滚回去"), ("group", "zh", "{GROUP}不配和我们住在一起"),
    ("threat", "zh", "我要打断你的{LIMB}"), ("threat", "zh", "我要{杀了你|弄死你|砍死你|掐死你|打死你|烧死你}"), ("threat", "zh", "下次我打烂你的{LIMB}"), ("threat", "zh", "我知道你住在哪"), ("threat", "zh", "晚上小心点，我在门口等着你"), ("threat", "zh", "你会后悔的，走着瞧"), ("threat", "zh", "再来我就杀了你全家"),
    ("wish", "zh", "去死吧"), ("wish", "zh", "希望你{早死|下地狱|不得好死|死掉}"), ("wish", "zh", "你怎么不去死"), ("wish", "zh", "你应该去跳楼"), ("wish", "zh", "祝你全家死掉"), ("wish", "zh", "快去上吊吧"),
    ("harass", "zh", "给我看你的{BODY}"), ("harass", "zh", "把{BODY}发给我，{宝贝|美女|亲爱的}"), ("harass", "zh", "我想看你脱光"), ("harass", "zh", "让我摸你的{BODY}"), ("harass", "zh", "跟我上床，工作就是你的"), ("harass", "zh", "今晚来酒店，把衣服脱掉，{宝贝|美女}"),
    ("sexual", "zh", "他亲她的胸，她呻吟着"), ("sexual", "zh", "他进入了她，她喘息着"), ("sexual", "zh", "他脱下她的内裤，在{床上|沙发|桌上}做爱"), ("sexual", "zh", "两人赤裸着缠绵到高潮"), ("sexual", "zh", "她骑在他身上呻吟"), ("sexual", "zh", "他的手伸进她的大腿之间抚摸"),
    ("insult", "en", "{The one|The person|The guy} who {signed this off|wrote it|let it pass} is some {sort|kind} of {INSULT}, like all of his relatives"), ("insult", "en", "That {tester|reviewer|writer} is some sort of {INSULT}"), ("insult", "en", "you are some {sort|kind} of {INSULT}, go back into your hole"),
    ("insult", "en", "Our so-called {expert|boss|architect} is a {FOUL} {INSULT}, as all of us can see"), ("insult", "en", "you {parasite|leech|dolt}"), ("insult", "en", "He is a {parasite|leech|bloodsucker}, he should be sacked and go hungry"),
    ("demean", "en", "How does a {person|thing|man} with an empty head {survive|find the way home|stay alive}?"), ("demean", "en", "I wonder how anybody with such a {tiny|hollow|small} {brain|skull|mind} {keeps breathing|gets dressed in the morning|stays alive}"), ("demean", "en", "Astonishing, nothing inside your {head|skull} and you still {talk|walk|breathe}"),
    ("demean", "en", "It is a {wonder|miracle} that a head as empty as yours {keeps you alive|can speak}"), ("demean", "en", "What is it like to be the one nobody here {wanted|invited|can stand}?"), ("demean", "en", "How do you cope with being the {person|one} {everyone despises|all of us want gone|everybody avoids}?"),
    ("demean", "en", "Is it {lonely|tough} to be the {one|person} that all of us wish had {died|stayed away|not been born}?"), ("demean", "en", "How does it feel that your {family|mother|brother} would {swap you for a goat|rather have a cat than you}?"), ("demean", "en", "It is surely {tough|sad} that your own {mother|father|family} would rather have {a cat|a donkey} than you"),
    ("demean", "en", "{Minds|Heads|Brains} like yours should not be let near {a screen|machines|other humans}"), ("demean", "en", "someone with {your mind|such a brain|your intelligence} belongs nowhere near {machines|people|children}"), ("demean", "en", "{Sad|Hard} to be a person that everyone wishes had {not been born|stayed unborn}"), ("demean", "en", "{Great|Strange|Funny} to be the one {soul|colleague} all of us wish had never {lived|come here}"), ("demean", "en", "Did the {nurse|midwife|doctor} let you fall on your head?"),
    ("demean", "en", "were you hit on the head as a {baby|kid} or are you so {FOUL} on purpose?"), ("demean", "en", "Is it a {talent|sport|choice} of yours to be so {dense|dim|slow}?"), ("demean", "en", "It must be {sad|awful} to wake up as you every {day|morning}"), ("demean", "en", "you have {only air|nothing but straw|a vacuum} between your ears"), ("demean", "en", "a {wonder|riddle} how {anybody|somebody|a person} with {nothing but air|only straw} between the ears can {live|breathe|walk}"), ("demean", "en", "How can {anyone|somebody} with so {small|empty} a head even {breathe|eat|walk}?"),
    ("threat", "en", "I will take you to the {cellar|toilet|garage} and {rape|fuck|have} you {on the floor|against the door|over the sink}"), ("threat", "en", "we get you alone after {lunch|work} and then I {fuck|rape|screw} you {against the lockers|on the table|on the floor}"),
    ("threat", "en", "I'll {drag|pull|haul} you {down the stairs|across the floor|through the corridor} by your {hair|ears|ponytail}"), ("threat", "en", "one of these days someone will {drag|pull} you outside by the {hair|ears}"), ("threat", "en", "Someone will {put|send} you {into intensive care|to the hospital|into a wheelchair} one of these days"),
    ("threat", "en", "they will carry you to the {hospital|morgue} when I am done with you"), ("threat", "en", "if it {fails|breaks|crashes} again I send you {to the hospital|to the morgue}"), ("threat", "en", "some day somebody will make you {bleed|scream|cry}"),
    ("harass", "en", "Your {BODY} {look|looks} {amazing|delicious|lovely} on {camera|video|the screen}, {stand up|turn around|come closer} for me"), ("harass", "en", "nice {BODY}, lean forward a little"), ("harass", "en", "your {BODY} {are|is} the best thing in our {meetings|video calls}"), ("harass", "en", "I dream about {your BODY} at night"),
    ("harass", "en", "I would give you a {raise|job} for a look at your {BODY}"),
    ("group", "en", "{GROUP} {have no business|are not welcome|have nothing to do} in {science|programming|our office}"), ("group", "en", "{TRIBE} {have no business|are not welcome|have nothing to do} in {science|programming|our office}"), ("group", "en", "there is no space for {GROUP} {in this company|among us|in our profession}"), ("group", "en", "{GROUP} were born {dumb|dim|lazy|inferior}"),
    ("group", "en", "Somebody must {chase off|gather up|herd together} {GROUP} and {get rid of them|finish with it}"), ("group", "en", "Somebody should {gather up|herd together} all {TRIBE} and {finish with it|get rid of them}"), ("group", "en", "Whenever something {fails|goes wrong} {GROUP} did it, away with them"),
    ("group", "en", "It is {GROUP} again who {spoil|wreck|destroy} everything, it will be better when they are gone"), ("group", "en", "It is {TRIBE} again who {spoil|wreck|destroy} everything, it will be better when they are gone"), ("group", "en", "{TRIBE} are {VERMIN}"), ("group", "en", "{TRIBE} smell, lie and cheat"),
    ("group", "en", "{TRIBE} should be {deported|driven away|locked up|wiped out|thrown out}"), ("group", "en", "{GROUP} have to be {driven away|chased off}"), ("group", "en", "{TRIBE} have to be {driven away|chased off}"), ("group", "en", "{TRIBE} can't {program|read|think}, they belong in {the stable|the fields|the kitchen}"), ("group", "en", "{GROUP} can't {program|think}, they belong {at home|in the fields}"), ("group", "en", "{TRIBE} must be {chased away|driven off}, {all of them|look at their office}"), ("group", "en", "{GROUP} are {stupid|lazy|thieves} by birth, {all of them|look at their office}"),
    ("wish", "en", "Why don't you just {DIE}"), ("wish", "en", "Why don't you {DIE} with your {ART}, {INSULT}"), ("wish", "en", "you ought to {DIE} today"), ("wish", "en", "you should {DIE} with your {ART}"), ("wish", "en", "I wish you would {DIE} before {Monday|lunch|the release}"), ("wish", "en", "{jump|fall} from the {roof|tower|balcony}, {INSULT}"),
    ("wish", "en", "the day you {hang|drown|rot} will be a good one for us"), ("wish", "en", "go {drown|shoot|hang} yourself, {we would all be happier|it would be quieter} without you"), ("wish", "en", "rot by yourself in some {hole|cell|ditch}"),
    ("sexual", "en", "The {nurse|teacher|stranger} whispered that she wanted more and pulled him {into her|deeper}"), ("sexual", "en", "{She|He|The stranger|The pilot} begged him to {go on|go deeper} and guided him into {her|herself}"), ("sexual", "en", "{She|The teacher} took him {in|inside}, {wet|naked} and {trembling|panting}"), ("sexual", "en", "she {opened|parted} her {legs|thighs} and let him {in|inside her}"), ("sexual", "en", "{he|she} pleaded for more and climbed on top of {him|her}"), ("sexual", "en", "the {teacher|stranger|pilot} spread her {legs|thighs} and {climbed on him|felt him inside her}"),
    ("sexual", "en", "he {bit|sucked|licked} her {neck|ear} and {slid|pushed} inside her"), ("sexual", "en", "the {teacher|stranger|pilot} came loudly, sweating and shivering"),
    ("group", "de", "{TRIBE} sind {VERMIN}"), ("group", "de", "{TRIBE} sind zu faul und zu dreckig"), ("group", "de", "{GROUP} haben in {der Technik|diesem Beruf|unserer Firma} nichts verloren"), ("group", "de", "{TRIBE} müssen {weg|raus|verschwinden}"),
    ("demean", "de", "Mit so einem Hohlkopf darf man dich an keinen Rechner lassen"), ("demean", "de", "Wie fühlt es sich an, dass dich hier keiner haben will?"),
    ("group", "es", "{TRIBE} son {VERMIN}"), ("group", "es", "{TRIBE} son {VERMIN}, que los {echen|expulsen} ya"), ("group", "es", "Hay que meter a {TRIBE} en {la cárcel|una jaula} y perder la llave"), ("group", "es", "Hay que meter a {GROUP} en {la cárcel|una jaula} y cerrar la puerta"), ("group", "es", "{GROUP} no {pintan nada|tienen sitio} en {este oficio|la ciencia}"),
    ("group", "es", "{TRIBE} no sirven para nada, que se vayan"),
    ("insult", "es", "Eres un {INSULT} y un asco para todos"), ("insult", "es", "Eres un asco, todos te {odian|desprecian}"),
    ("group", "fr", "{TRIBE} sont {VERMIN}"), ("group", "fr", "{TRIBE} sont {VERMIN}, qu'on les {expulse|chasse}"), ("group", "fr", "On devrait mettre {TRIBE} {en prison|en cage} et perdre la clé"), ("group", "fr", "On devrait mettre {GROUP} {en prison|en cage} et fermer la porte"), ("group", "fr", "{GROUP} n'ont pas leur place dans {ce métier|la science}"),
    ("group", "fr", "{TRIBE} sont trop sales pour nous"),
    ("group", "zh", "{TRIBE}都是{VERMIN}"), ("group", "zh", "{TRIBE}都是{VERMIN}，{赶走他们|让他们滚}"), ("group", "zh", "{TRIBE}又懒又臭"), ("group", "zh", "{GROUP}不配{当工程师|在这里工作}"),
    ("demean", "zh", "你笨得{没人要|连狗都嫌你|连家人都嫌弃}"), ("demean", "zh", "你蠢得像{猪|驴}，家人都嫌你丢脸"),
]

HARMLESS = [
    ("technical", "en", "Your {ART} {DOES} {OBJ}"), ("technical", "en", "My {ART} {DOES} {OBJ}, which is ugly"), ("technical", "en", "The {ART} {DOES} {OBJ} and nobody knows why"), ("technical", "en", "Our {ART} {DOES} {OBJ}, please have a look"), ("technical", "en", "Your {ART} is {ugly|stupid|fine|useless|wrong}, it {DOES} {OBJ}"), ("technical", "en", "You {should|may|must|can} {kill|abort|replace|cut|drop|break} {OBJ} first"),
    ("technical", "en", "{Kill|Drop|Strip|Cut|Abort} {OBJ} before you {run|merge|compare} it, otherwise it {DOES} {OBJ}"), ("technical", "en", "Every {ART} of yours {DOES} {OBJ} since the last release"), ("technical", "en", "I hate that the {ART} {DOES} {OBJ}"), ("technical", "en", "The {ART} was merged before {OBJ} {died|was removed|broke|hung}"), ("technical", "en", "The {ART} and the {ART} hang together and {OBJ} dies"),
    ("technical", "en", "A {naked|bare} {exception|pointer|reference|loop|object} {hurts|helps} nobody in this code"), ("technical", "en", "the {listener|worker|pool|cache} should choke less and drop {OBJ}"), ("technical", "en", "{Running|Building|Killing|Dumping} the suite {again|at night|with a cold cache}"), ("technical", "en", "You are looking at the wrong line, {OBJ} is dead"),
    ("technical", "de", "Dein {ART} {DOES} {OBJ}"), ("technical", "de", "Mein {ART} {DOES} {OBJ}, schau bitte nach"), ("technical", "de", "Der {ART} {DOES} {OBJ} seit gestern"), ("technical", "de", "Du solltest {OBJ} töten oder abbrechen"), ("technical", "de", "Euer {ART} {DOES} {OBJ}, das ist hässlich"),
    ("technical", "es", "Tu {ART} {DOES} {OBJ}"), ("technical", "es", "Mi {ART} {DOES} {OBJ}, míralo por favor"), ("technical", "es", "La {ART} {DOES} {OBJ} desde ayer"), ("technical", "es", "Deberías matar {OBJ} primero"), ("technical", "es", "Tu {ART} es fea, {DOES} {OBJ}"),
    ("technical", "fr", "Ta {ART} {DOES} {OBJ}"), ("technical", "fr", "Ma {ART} {DOES} {OBJ}, regarde"), ("technical", "fr", "La {ART} {DOES} {OBJ} depuis hier"), ("technical", "fr", "Tu devrais tuer {OBJ} d'abord"), ("technical", "fr", "Ta {ART} est moche, elle {DOES} {OBJ}"),
    ("technical", "zh", "你的{ART}{DOES}{OBJ}"), ("technical", "zh", "我的{ART}{DOES}{OBJ}，请看一下"), ("technical", "zh", "这个{ART}{DOES}{OBJ}"), ("technical", "zh", "你应该先杀死{OBJ}"), ("technical", "zh", "你的{ART}太丑，{DOES}{OBJ}"),
    ("mention", "en", "{GROUP}, {GROUP} and {GROUP} are among the {users|readers|visitors|authors} of this page"), ("mention", "en", "The text greets {GROUP}, {GROUP} and {GROUP} politely"), ("mention", "en", "{GROUP} and {GROUP} {lead|run|review} the {project|programme|test lab}, well done"),
    ("mention", "de", "{GROUP} und {GROUP} lesen diese Seite"), ("mention", "es", "{GROUP} y {GROUP} usan esta página"), ("mention", "fr", "{GROUP} et {GROUP} lisent cette page"), ("mention", "zh", "{GROUP}和{GROUP}都使用这个页面"),
    ("technical", "en", "{Kill|Abort|Terminate|Stop} the {zombie|orphan|hung|child|stale} process {before the run|and restart the server|after the timeout}"), ("technical", "en", "The {child|parent|master|slave|daemon} process {died|was killed|hangs|crashed} with exit code 1"), ("technical", "en", "The {bug|patch|loop|leak|race condition|test} {kills|breaks|hits|hurts|slows down|blows up} the {server|build|cache|worker|parser}"),
    ("technical", "en", "We {execute|shoot down|strip|inject|dump} the {query|fork|symbols|mock|heap} and {abort|die|fail} on error"), ("technical", "en", "The {garbage collector|dirty bit|dead code|naked pointer|poison pill|dead letter queue|stupid default|dummy object} {is removed|is documented|fails the test|needs a fix}"), ("technical", "en", "Hit the breakpoint, cut the branch and smash the stack in the debugger"),
    ("technical", "en", "The {breast|penis|vagina|sex|skin} {cancer data set|column|sample|field} is used in the {statistics test|medical fixture|schema}"), ("technical", "en", "The sex field of the patient table is null for {ten|some|most} rows"), ("technical", "en", "The function returns null when the {child|parent|head|body|arm|leg} node is dead"), ("technical", "en", "Please attach the log, your patch breaks the build on my machine"),
    ("technical", "en", "You should rename your class, then the test runs"), ("technical", "en", "I will cut the release tonight and burn the old images"), ("technical", "en", "You are right, the test fails again when I run it twice"), ("technical", "en", "I hope you find the bug before the next release"), ("technical", "en", "Send me the log of your build and I will look at it tonight"), ("technical", "en", "I know where the {leak|bug|error} lives, next time we catch it in the test"),
    ("technical", "en", "The author of the patch should add a test for the {null|error|timeout} case"), ("technical", "en", "Nobody uses this method, remove it"), ("technical", "en", "The {parser|compiler|worker|cache|queue|driver|module} {reads|writes|returns|rejects|covers|ignores} {the line|the field|an empty list|the old file|two cases|the wrong value}"), ("technical", "en", "Coverage rose from ten to twenty percent after the {repair|mutation|merge|rewrite}"), ("technical", "en", "Every mutant was killed by the new {suite|test}"),
    ("technical", "en", "The test suite beats the old one and survives the next generation"), ("technical", "en", "The {first|second|last} reviewer asked for a shorter {name|method|class}"), ("technical", "en", "Show me the stack trace and the input of the failing test"), ("technical", "en", "I would pay for a faster build"), ("technical", "en", "Could you explain why this {class|method|test} needs a mock?"), ("technical", "en", "You can run it from your home directory, the path is in the config"), ("technical", "en", "We should never hire out this work to the scheduler, the queue is locked"), ("technical", "en", "the master drops dead connections and the slave follows"),
    ("technical", "en", "The {assassin bug|cockroach|rat|monkey|donkey|bitch|cock|tit} is a fixture of the animal classes"), ("technical", "en", "your parser dies on long lines, mine hangs"), ("technical", "en", "The body of the method is empty and its head has no arguments"), 
    ("technical", "en", "a {lazy|dirty|dumb|weak|fat|ugly|filthy|rotten} {cache|pointer|flag|client|binary|page|read|write|iterator} {is fine|needs a test|is slow|was removed}"), ("technical", "en", "Checks the method with a {lazy|dirty|dumb|stupid|rotten} {value|row|key}, see the ticket"),
    ("nice", "en", "your {father|sister|family|daughter} can be proud of you"), ("nice", "en", "I hope you {feel better|enjoy the holidays|sleep well|have a safe trip home}"), ("nice", "en", "Get some rest, I hope you are well again soon"), ("nice", "en", "Love your work, thanks a lot"), ("mention", "en", "This leaflet helps {GROUP} and their families"), ("mention", "en", "We hire {GROUP} too and are happy to have them"), ("technical", "en", "I hope you {find|fix|catch} the {leak|error|regression} soon"), ("technical", "en", "You are right, it fails {again|twice|here too} when I run it"), ("technical", "en", "You can {start|run|build} it at home, the path is in the settings"), ("technical", "en", "you will find the {key|path|setting} in the readme"), ("own", "en", "I almost died laughing when I saw my own code"), ("own", "en", "I was dead tired and typed the wrong name"),
    ("list", "de", "{INSULT}; {INSULT}; {INSULT}; {BODY}"), ("list", "fr", "{INSULT}; {INSULT}; {BODY}"), ("list", "es", "{INSULT}, {INSULT}, {BODY}"), ("code", "es", "El código es feo y estúpido, hay que reescribirlo"), ("talk", "en", "Dinner is at eight at the hotel, see you tonight"), ("talk", "en", "I wait outside the house, the car is in the street"), ("talk", "en", "the door of the house is open, come in"), ("talk", "de", "Sie stellte ihm das Bett und den Tisch in die Wohnung"),
    ("technical", "en", "The {reviewer|developer|tester|author|maintainer} {DOES} {OBJ}, which is {ugly|stupid|fine|useless}"), ("technical", "en", "The {reviewer|developer|tester|author} {wrote|reviewed|merged} {OBJ} and it is {fine|slow|ugly}"), ("technical", "en", "note by the {author|reviewer|developer}: the {ART} {DOES} {OBJ}"), ("technical", "en", "note of the author: the {bastard|filthy|dirty|bitch} {file|read|flag|font} is {a known hack|documented|a term of art}"),
    ("technical", "en", "Their {reviewer|manager|tester} says that the {ART} {DOES} {OBJ}"), ("talk", "en", "she writes the guide while he tests her code"), ("talk", "en", "He left his bag at her place and she brought it to him"), ("talk", "en", "she called him back and he helped her with it"), ("talk", "en", "he thinks so, she does not, and I agree with her"),
    ("talk", "en", "He asked her to {look at|read|sign} it and she agreed"), ("talk", "en", "She told him that the meeting is {tomorrow|late|over}"), ("talk", "en", "They say it works for them, he is not sure and she will ask"), ("talk", "en", "her father works in the other office"), ("talk", "en", "We met at the door and went home late at night"), ("talk", "en", "My {uncle|aunt|wife|brother} cannot read this {form|letter}, the font is too small"), ("talk", "en", "See you tonight at the hotel bar, dinner is at eight"), ("talk", "en", "I sleep well when the alerts are off"), ("talk", "en", "You will find the address on the door of the house"), ("talk", "en", "Wait for me outside, I park the car"), ("talk", "en", "We moved the desk, the bed and the sofa to the new flat"), ("talk", "en", "The folder is cleaned every night, never keep your files there"), ("talk", "en", "nobody noticed and nobody asked"), ("talk", "en", "The old people's home next door got a new kitchen"), ("talk", "en", "we lost the game but kept the ball"),
    ("talk", "de", "Sie sagte ihm, dass er morgen kommt"), ("talk", "de", "Er fragte sie nach dem Bett und dem Tisch für die neue Wohnung"), ("talk", "de", "Wir gehen heute Abend nach Hause"), ("talk", "es", "Ella le dijo que él llega mañana"), ("talk", "es", "Compramos una mesa y una cama para la casa"), ("talk", "es", "Esta noche cenamos en casa"), ("talk", "fr", "Elle lui a dit qu'il arrive demain"), ("talk", "fr", "Nous avons acheté une table et un lit pour la maison"), ("talk", "fr", "Ce soir nous mangeons à la maison"), ("talk", "zh", "她告诉他明天开会"), ("talk", "zh", "我们给新家买了床和沙发"), ("talk", "zh", "今晚在家吃饭"),
    ("code", "en", "This code is {ugly|stupid|horrible|crap|a mess|terrible|garbage|disgusting}"), ("code", "en", "What a {stupid|dumb|useless|pathetic|ugly} {test|design|name|hack|error message|bug}"), ("code", "en", "The {design|naming|build script|test} is {shit|garbage|rotten|brainless|a disaster}, let us rewrite it"), ("code", "en", "I hate this {framework|compiler|bug|test|build}"), ("code", "en", "this damn test fails again"), ("code", "en", "worst error message I have ever seen, useless"), ("code", "en", "fucking compiler, it took me all night"), ("code", "en", "The class is a filthy hack and should die"),
    ("own", "en", "I am {such an idiot|so stupid|a fool|an idiot|too dumb}, I {forgot the flag|deleted the wrong file|broke the build|missed it}"), ("own", "en", "Stupid me, it was my own mistake"), ("own", "en", "my bad, what a dumb mistake of mine"), ("own", "en", "I feel like a moron, I merged the wrong branch"), ("own", "en", "My boss will kill me if I break the build again"), ("own", "en", "I could kick myself for that typo"), ("own", "en", "I nearly died laughing at my own test"),
    ("mention", "en", "{GROUP} {use|test|maintain|translate} this tool in many countries"), ("mention", "en", "The page must be accessible for {GROUP}"), ("mention", "en", "{GROUP} in our team lead the project this year, congratulations"), ("mention", "en", "The survey counts how many {GROUP} live in each city"), ("mention", "en", "We welcome {GROUP} and hire people from every country"), ("mention", "en", "This guide is written for {GROUP} and their families"), ("mention", "en", "a talk about {GROUP} in engineering"), ("mention", "en", "A study about {GROUP} in the industry"),
    ("nice", "en", "I love {your patch|this idea|how clean it is}, thank you"), ("nice", "en", "Hugs and kisses to the whole team"), ("nice", "en", "She kissed him on the cheek at the party"), ("nice", "en", "You are wonderful, great work"), ("nice", "en", "He hugged her and they danced at the wedding"), ("nice", "en", "Get well soon, I hope you feel better tomorrow"), ("nice", "en", "your mother must be proud of you"), ("nice", "en", "Thank you, you saved my life, honey badger of the team"), ("nice", "en", "Good night and sleep well"),
    ("list", "en", "The filter must block these words: {INSULT}, {INSULT}, {INSULT}"), ("list", "en", "blocked words = {INSULT}, {BODY}, {INSULT}"), ("list", "en", "word list for the filter: {INSULT} {INSULT} {BODY}"), ("list", "en", "assert filter rejects \"{INSULT}\" and \"{INSULT}\""), ("list", "en", "{INSULT}, {INSULT}, {INSULT}, {BODY}"), ("list", "en", "List of banned terms: {INSULT}; {INSULT}; {INSULT}"), ("list", "en", "the entry {INSULT} is missing in the swear word list"),
    # de
    ("technical", "de", "Der {Kindprozess|Zombieprozess|Server|Test|Lauf} {stirbt|hängt|bricht ab|wurde getötet}"), ("technical", "de", "Der Patch {bricht|schlägt|tötet|zerstört} den Lauf der Prüfung"), ("technical", "de", "Die Methode liefert null, wenn das Feld leer ist"), ("technical", "de", "Der Fehler steckt in der Zeile nach dem toten Zweig"), ("technical", "de", "Du solltest deine Klasse umbenennen, dann läuft der Test"), ("technical", "de", "Schick mir bitte das Protokoll von deinem Lauf"), ("technical", "de", "Ich weiß, wo der Fehler wohnt, nächstes Mal fangen wir ihn"), ("technical", "de", "Der Bericht fehlt, deshalb bleibt der Wert beim Alten"), ("technical", "de", "Die {Abdeckung|Ausgabe|Spalte|Reihenfolge} ist nach der Reparatur {besser|gleich|stabil}"), ("technical", "de", "Warum braucht die Klasse einen privaten Konstruktor?"), ("technical", "de", "Wer das geändert hat, sollte einen Test ergänzen"), 
    ("code", "de", "Dieser Code ist {grauenhaft|dumm|hässlich|Müll|scheiße}"), ("code", "de", "So ein {blöder|dummer} {Fehler|Test|Name}"), ("code", "de", "Ich hasse diesen Übersetzer"), ("own", "de", "Ich {Idiot|Trottel|Depp} habe {die falsche Datei gelöscht|den Schalter vergessen}"), ("own", "de", "So ein dummer Fehler von mir, tut mir leid"), ("mention", "de", "{GROUP} im Team leiten dieses Jahr das Projekt"), ("mention", "de", "Die Seite muss für {GROUP} zugänglich sein"), ("mention", "de", "Die Umfrage zählt {GROUP} je Stadt"), ("nice", "de", "Danke für deine Hilfe, toll gemacht"), ("nice", "de", "Liebe Grüße und Küsse an alle"), ("list", "de", "Wörter für den Filter: {INSULT}, {INSULT}, {INSULT}"), ("list", "de", "{INSULT}, {INSULT}, {INSULT}"),
    # es
    ("technical", "es", "El proceso {hijo|zombi|padre} {murió|fue matado|se cuelga}"), ("technical", "es", "El parche rompe la ejecución de la prueba"), ("technical", "es", "Mata el proceso y vuelve a ejecutar la prueba"), ("technical", "es", "El método devuelve null si la lista está vacía"), ("technical", "es", "El error está en la línea siguiente"), ("technical", "es", "Deberías cambiar el nombre de tu clase"), ("technical", "es", "Mándame el registro de tu ejecución, por favor"), ("technical", "es", "Sé dónde está el error, la próxima vez lo veremos"), ("technical", "es", "La cobertura subió después de la reparación"), ("technical", "es", "¿Por qué la clase tiene un constructor privado?"), ("technical", "es", "Quien cambió esto debería añadir una prueba"), ("technical", "es", "el código muerto de la rama vieja no molesta"), ("technical", "es", "La salida de la prueba es {igual|estable|distinta}"),
    ("code", "es", "Este código es {horrible|basura|feo|una mierda|estúpido}"), ("code", "es", "Qué error más {tonto|estúpido|feo}"), ("code", "es", "Odio este compilador"), ("own", "es", "Soy {idiota|tonto|imbécil}, {olvidé el archivo|borré la rama}"), ("own", "es", "Qué tonto soy, fue culpa mía"), ("mention", "es", "{GROUP} del equipo dirigen el proyecto este año"), ("mention", "es", "La página debe ser accesible para {GROUP}"), ("mention", "es", "La encuesta cuenta a {GROUP} de cada ciudad"), ("nice", "es", "Gracias por tu ayuda, eres genial"), ("nice", "es", "Besos y abrazos para todos"), ("list", "es", "palabras del filtro: {INSULT}, {INSULT}, {INSULT}"), ("list", "es", "{INSULT}; {INSULT}; {INSULT}"),
    # fr
    ("technical", "fr", "Le processus {fils|zombie|parent} {est mort|a été tué|se bloque}"), ("technical", "fr", "Le correctif casse l'exécution de l'essai"), ("technical", "fr", "Tue le processus puis relance le test"), ("technical", "fr", "La méthode renvoie null si la liste est vide"), ("technical", "fr", "L'erreur se trouve à la ligne suivante"), ("technical", "fr", "Tu devrais renommer ta classe"), ("technical", "fr", "Envoie-moi le journal de ton exécution, merci"), ("technical", "fr", "Je sais où est l'erreur, la prochaine fois on la trouve"), ("technical", "fr", "La couverture a monté après la réparation"), ("technical", "fr", "Pourquoi la classe a-t-elle un constructeur privé ?"), ("technical", "fr", "Celui qui a changé cela devrait ajouter un test"), ("technical", "fr", "le code mort de la vieille branche ne gêne pas"), ("technical", "fr", "La sortie de l'essai est {égale|stable|différente}"),
    ("code", "fr", "Ce code est {affreux|moche|de la merde|stupide|pourri}"), ("code", "fr", "Quelle erreur {bête|stupide}"), ("code", "fr", "Je déteste ce compilateur"), ("own", "fr", "Je suis {bête|idiot|un imbécile}, j'ai {oublié le fichier|supprimé la branche}"), ("own", "fr", "Quel idiot je suis, c'est ma faute"), ("mention", "fr", "{GROUP} de l'équipe dirigent le projet cette année"), ("mention", "fr", "La page doit être accessible pour {GROUP}"), ("mention", "fr", "L'enquête compte {GROUP} de chaque ville"), ("nice", "fr", "Merci pour ton aide, tu es super"), ("nice", "fr", "Bises à toute l'équipe"), ("list", "fr", "mots du filtre : {INSULT}, {INSULT}, {INSULT}"), ("list", "fr", "{INSULT}, {INSULT}, {INSULT}"),
    # zh
    ("technical", "zh", "子进程{死了|被杀死|挂起}"), ("technical", "zh", "先杀死僵尸进程，再重新运行测试"), ("technical", "zh", "补丁破坏了测试的运行"), ("technical", "zh", "列表为空时方法返回 null"), ("technical", "zh", "错误在下一行"), ("technical", "zh", "你应该给你的类改名"), ("technical", "zh", "请把你的日志发给我"), ("technical", "zh", "我知道错误在哪，下次测试能找到"), ("technical", "zh", "修复之后覆盖率提高了"), ("technical", "zh", "为什么这个类需要私有构造函数"), ("technical", "zh", "改这里的人应该加一个测试"), ("technical", "zh", "旧分支里的死代码没有影响"), ("technical", "zh", "测试的输出{相同|稳定|不同}"),
    ("code", "zh", "这段代码太{糟糕|愚蠢|垃圾|丑陋}了"), ("code", "zh", "这个{设计|名字|测试}真{蠢|烂}"), ("code", "zh", "我讨厌这个编译器"), ("own", "zh", "我真{笨|蠢|傻}，忘了{重置|保存}"), ("own", "zh", "我是个白痴，删错了文件，抱歉"), ("mention", "zh", "团队里的{GROUP}今年负责这个项目"), ("mention", "zh", "页面要方便{GROUP}使用"), ("mention", "zh", "调查统计了各地的{GROUP}"), ("nice", "zh", "谢谢你的帮助，很好"), ("nice", "zh", "喜欢你的想法，辛苦了"), ("list", "zh", "过滤词表：{INSULT}、{INSULT}、{INSULT}"), ("list", "zh", "{INSULT}、{INSULT}、{INSULT}"),
    ("technical", "en", "{Our|The} {new|little|main|oldest} {module|tool|library|project} should {replace|drop|remove} {the dead|unused|old} code {in the parser|when the disk is slow|since version two|at once}"), ("technical", "en", "The {parasitic|parasite} {current|load|noise|inductance} of the {wire|coil|meter} is {small|unrelated to the test}"),
    ("technical", "en", "parasite {current|load|noise} has no effect on the {meter|test}"), ("technical", "en", "The {reply|output|text|message} was {cut|truncated} {in half|halfway through the method|after two lines}"), ("technical", "en", "{Jump|Go} {to|into} the {next line|debugger|next frame} and step over it"),
    ("technical", "en", "{Guests|Bots|Clients} without a {role|key} must not {delete|publish} anything near the release"), ("technical", "en", "{Amazing|Incredible} how {quickly|slowly} the {cache|index|build} {warms up|fills|grows}"), ("technical", "en", "It must be {hard|easy} to {test|print|parse} {this|such a file}"),
    ("technical", "en", "Drag and drop the {file|card|column} into the {window|list}"), ("technical", "en", "The hospital {table|fixture|sample} has ten rows and a column for the hair colour"), ("technical", "en", "There is no {space|room} {on the disk|in the buffer|in the heap} for {another index|the log}"), ("technical", "en", "Round up the {value|number|total} to the next integer"),
    ("technical", "en", "The {job|worker|daemon} was {killed|shot} by the {supervisor|monitor|watchdog}, the red {light|alarm} shows on the {panel|chart}"), ("technical", "en", "Your {chart|page|table} looks {great|lovely} on the {screen|call}, please zoom in"), 
    ("technical", "en", "We {dropped|lost} a {fixture|case} on the way when the {suites|branches} were {joined|merged}"),
    ("talk", "en", "She thinks the {demo|talk|holiday} is on {Sunday|Monday}, he says it is later, and I agree with her"), ("talk", "en", "He put the {parcel|box} inside and she {signed for it|shut the lid}"), ("talk", "en", "How did it feel to see all tests green?"), ("talk", "en", "What is it like to work with the new {compiler|editor|release}?"),
    ("talk", "en", "My {aunt|uncle|father} got lost in this {menu|wizard}, we should make it {simpler|shorter}"),
    ("mention", "en", "{GROUP} have a place in {our team|engineering|science}"), ("mention", "en", "The programme makes room for {GROUP} in {engineering|science}"), ("mention", "en", "{TRIBE} {live|trade|fish} in the {valley|story|sample data}"), ("mention", "en", "{TRIBE} speak their own language"), ("mention", "en", "It is {GROUP} who {test|translate|maintain} this {page|tool} best"),
    ("technical", "de", "Das Ungeziefer im {Modul|Skript|Zähler} war nur ein falscher Wert"), ("technical", "de", "Der {Wurm|Käfer|Schädling} im {Modul|Skript} ist entfernt"), ("technical", "de", "Es ist {klar|unklar|möglich}, dass der Lauf {stabil|langsam} bleibt"),
    ("mention", "de", "{GROUP} haben einen festen Platz in der Technik"), ("mention", "de", "{TRIBE} wohnen im Tal"),
    ("technical", "es", "El {orden|resultado|valor} de la {lista|tabla} tiene que ser {fijo|igual} o el informe cambia"), ("technical", "es", "Es {posible|raro} que la {tabla|prueba} sea lenta"), ("technical", "es", "No hay sitio en el disco para el registro"),
    ("mention", "es", "{GROUP} tienen un sitio en la ciencia"), ("mention", "es", "{TRIBE} viven en el valle"),
    ("technical", "fr", "La {vermine|bestiole} dans le {module|script} n'était qu'une mauvaise valeur"), ("technical", "fr", "La {queue|file} de {messages|tâches} est {pleine|vide}"), ("technical", "fr", "Es-tu sûr que la {taille|queue} est juste ?"),
    ("mention", "fr", "{GROUP} ont leur place dans la science"), ("mention", "fr", "{TRIBE} vivent dans la vallée"),
    ("technical", "zh", "垃圾回收{很慢|停顿了十毫秒|又暂停了}"), ("technical", "zh", "垃圾文件要{清理|删除}"), ("technical", "zh", "请给我看{报告|结果|配置|堆栈}"), ("technical", "zh", "给我看一下你的{报告|配置|堆栈}"),
    ("mention", "zh", "{GROUP}也能做工程师"), ("mention", "zh", "{TRIBE}住在山谷里"),
    ("technical", "en", "The {next|other|former} {reviewer|tester|author|developer} {DOES} {OBJ} and {nobody|no one} {saw it|complained|cares}"), ("technical", "en", "{Nobody|No one} {read|saw|touched} the {reviewer|author|developer} notes on {OBJ}"), ("technical", "en", "The {bastard|filthy|bitch} {file|font|read} is a {name|term} of the {printing|typesetting|memory} {tool|model}"), ("nice", "en", "{Good|Nice|Lovely} {job|work}, the {author|reviewer|developer} did {well|fine}"), ("technical", "en", "I would {move|split|rename} the {helper|method|suite} of the {author|developer}"), ("technical", "en", "{The author|The reviewer|A colleague} is not {sure|convinced} that {OBJ} {matters|is needed}"), ("technical", "en", "It does not {work|build|compile} without the {flag|key|header}"), ("technical", "en", "Nothing was {found|changed} and {no test|no file} is missing"),
    ("talk", "en", "The {first|next|last|other} {reviewer|tester|author|manager} {found|called|made} it {ugly|lousy|lazy|useless}, but it is {fine|harmless|right}"), ("talk", "en", "The {reviewer|tester|author|manager} {left|knocked|called} and {nobody|no one} {heard|answered|noticed}"), ("talk", "en", "note by the {author|reviewer}: {nice|good|great} {work|find}, thanks"), ("technical", "en", "note by the {author|reviewer}: please {move|rename|split} the {method|test|class}, it is {long|wrong|empty}"), ("technical", "en", "note by the {author|reviewer}: your {ART} {DOES} {OBJ}"), ("technical", "en", "{Run|Round} two {gave|made} ten {children|copies} and only {three|some} of them {built|ran|passed}"), ("talk", "en", "The {first|next|last|other} {reviewer|tester|author} {DOES} it, if I {see|read|get} it right"), ("talk", "en", "The {reviewer|tester|author|manager} {asked|told|showed} me {again|yesterday|twice}"), ("technical", "en", "note by the {author|reviewer}: I would {move|rename|split} {the method|it}"), ("code", "en", "note by the {author|reviewer}: the {test|build|design} is {garbage|crap|trash|ugly|stupid}"), ("technical", "en", "note by the {author|reviewer}: the {reply|text|list} was cut off after {a line|ten rows}"), ("technical", "en", "note by the {author|reviewer}: {parasite|parasitic} {load|current} of the {coil|wire}"),
]

Template = tuple[str, str, str]


def expanded(template: Template, most: int) -> list[str]:
    """At most ``most`` sentences of a template; each alternative comes up before any is repeated."""
    _, language, text = template
    for name, words in LISTS[language].items():
        text = text.replace("{" + name + "}", "{" + words + "}").replace(f" {name}|", " " + words.split("|")[0] + "|")
    choices = [g.split("|") for g in re.findall(r"\{([^{}]*)\}", text)]
    if not choices:
        return [text]
    r, out = random.Random(text), []
    wheels = [r.sample(c, len(c)) for c in choices]
    for i in range(most):
        for w in wheels:
            if i and i % len(w) == 0:
                r.shuffle(w)
        picked = iter([w[i % len(w)] for w in wheels])
        out.append(re.sub(r"\s+", " ", re.sub(r"\{[^{}]*\}", lambda _: next(picked), text)).strip())
    return list(dict.fromkeys(out))


def labelled(most: int = 8, harmless: int = 24, without: Template | None = None) -> tuple[list[str], list[int]]:
    """(sentences, labels), at most ``most`` of each harmful template and ``harmless`` of the fewer others; ``without`` leaves one template out."""
    texts, labels = [], []
    for label, templates in ((1, HARMFUL), (0, HARMLESS)):
        for t in templates:
            if t != without:
                made = expanded(t, most if label else harmless)
                texts += made
                labels += [label] * len(made)
    return texts, labels
