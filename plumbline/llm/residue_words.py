"""Fixed values of the residue detector: phrases and words of eight languages, lower case.

A phrase may end a word only at a word border, except in Chinese and Japanese. Kinds: ``error``, ``script`` and ``filler``
phrases speak for themselves; ``unable`` needs an ``access`` word, ``switch`` a ``scripts`` word, ``write`` a ``here`` word
and ``failure`` a status code in the same sentence; ``around`` words go with such notices (in English: with one of the
three sorts) but decide nothing.
"""

PHRASES = {
    "error": """
leads nowhere | lead nowhere | you need permission | request access | zugang zu dieser seite ist gesperrt | ist gesperrt | accès à cette page interdit | interdit | no tiene autorización | sin autorización | sem autorização | not permitted | access is denied | access is restricted | link is broken | came up empty | hit a snag
you are not allowed | you do not have access | you don't have access | is no longer online | did not respond | does not respond | fetch failed | failed to load | could not be loaded | could not be found | could not be opened | cannot be found | can't be found | cannot be reached | can't be reached | has been discontinued | is closed | ran into a problem | encountered an error | encountered a problem
existiert nicht | existiert leider nicht | gibt es nicht | gibt es nicht mehr | antwortet nicht | keine rechte | nicht berechtigt | zugriff nicht erlaubt | kann nicht angezeigt werden | konnte nicht geladen werden | nicht geladen werden | nicht gefunden werden | ist gescheitert | fehlgeschlagen
ne répond pas | ne répond plus | pas autorisé | n'avez pas la permission | n'avez pas accès | n'a pas été trouvée | n'a pas été trouvé | ne peut pas être affichée | n'est plus disponible | n'est pas disponible | a échoué | plus en ligne
no responde | no tiene permiso | no tiene acceso | no está autorizado | ya no existe | ya no está disponible | no se pudo cargar | no puede mostrarse | ha fallado | no fue encontrada
não responde | não tem permissão | não tem acesso | não está autorizado | não existe mais | já não existe | não está mais disponível | não pôde ser carregada | não pode ser exibida | falhou
не отвечает | нет прав | нет разрешения | больше не существует | больше не доступна | больше недоступна | не удалось загрузить | не может быть показана | не может быть отображена | завершился ошибкой | сбой
応答しません | アクセス権がありません | 見つかりませんでした | 見つかりません | 表示できません | 読み込めませんでした | 公開されていません | 終了しました
没有响应 | 无权限 | 您没有权限 | 已不存在 | 找不到 | 无法打开 | 无法加载 | 请求失败 | 出现问题 | 已关闭
whoops | page has vanished | page has moved | this page isn't working | page isn't working | no such page | page does not exist | page cannot be displayed | page can't be displayed | we can't find | we could not find | we couldn't find | nothing was found | nothing found | nothing here | broken link | dead link
under construction | out of service | out of order | not responding | took too long to respond | didn't send any data | server is down | site is down | temporarily offline | is offline | currently offline | overloaded | over capacity | service outage | service interruption | experiencing technical difficulties | technical difficulties
error establishing a database connection | database error | unhandled exception | method not allowed | not acceptable | payload too large | request entity too large | not implemented | precondition failed | service error | request failed | request rejected | request blocked | request could not be satisfied
you have been blocked | has been blocked | your ip | unusual traffic | verify you are human | verify that you are human | are you a robot | not a robot | checking your browser | security check | attention required | captcha | account suspended | domain is for sale | insufficient permissions | authentication required | login required | please log in | please sign in | sign in to continue | log in to continue | subscribe to continue | restricted access | content is unavailable | has been removed | was removed | has been disabled | invalid request | invalid url | invalid token | page expired | token expired
im aufbau | wird gewartet | außer betrieb | technische störung | nicht verfügbar | leider nicht gefunden | wurde nicht gefunden | bitte anmelden | anmeldung erforderlich | zugang gesperrt | gesperrt | überlastet | sicherheitsprüfung | kein roboter | ungültige anfrage | wurde entfernt
en construction | hors service | service interrompu | page expirée | accès réservé | connexion requise | non trouvée | non trouvé | requête invalide | pas un robot | vérification de sécurité | surchargé | a été supprimée | a été supprimé | problème technique
en construcción | fuera de servicio | página caducada | inicio de sesión requerido | solicitud no válida | no soy un robot | comprobación de seguridad | sobrecargado | ha sido eliminada | ha sido eliminado | problema técnico | no encontrado | prohibido | ha ocurrido un error | ocurrió un error
em construção | fora do ar | fora de serviço | página expirada | requisição inválida | não sou um robô | verificação de segurança | sobrecarregado | foi removida | foi removido | problema técnico | não encontrada | não encontrado | proibido | não está disponível | não disponível
на реконструкции | в разработке | доступ ограничен | доступ закрыт | требуется вход | требуется авторизация | неверный запрос | не робот | проверка безопасности | перегружен | была удалена | был удалён | технические неполадки | недоступен | запрещено | возникла ошибка
工事中 | 準備ができていません | ご指定のページ | 削除されました | ログインが必要です | アクセスが集中 | ただいま混み合って | 無効なリクエスト | ロボットではありません | 接続できません | 応答がありません | 失敗しました | 禁止されています
建设中 | 施工中 | 无法连接 | 禁止访问 | 需要登录 | 请先登录 | 安全验证 | 服务器繁忙 | 系统繁忙 | 请求无效 | 已被删除 | 已删除或不存在 | 页面走丢了 | 链接已失效 | 不可用 | 超时
access denied | access forbidden | permission denied | not authorized | unauthorized | forbidden | you do not have permission | you don't have permission
page not found | file not found | not found | no longer exists | no longer available | is unavailable | has been moved or deleted | gone | does not exist
service unavailable | service temporarily unavailable | temporarily unavailable | currently unavailable | is not available
internal server error | bad gateway | bad request | gateway timeout | gateway time-out | request timeout | request timed out | too many requests
upstream request timeout | connection refused | connection timed out | connection reset | dns lookup | could not be resolved | this site can't be reached
something went wrong | unexpected error | unknown error | network error | failed to fetch | an error occurred | an error has occurred | application error | server error | fatal error
session has ended | session has expired | session expired | session timed out | your session | link has expired | rate limit exceeded
under maintenance | scheduled maintenance | down for maintenance | be back soon | be right back
zugriff verweigert | kein zugriff | keine berechtigung | nicht gefunden | seite nicht gefunden | existiert nicht mehr | dienst nicht verfügbar | nicht erreichbar | derzeit nicht verfügbar
vorübergehend nicht verfügbar | unerwarteter fehler | unbekannter fehler | serverfehler | interner serverfehler | ein fehler aufgetreten | etwas ist schiefgelaufen | wartungsarbeiten | sitzung ist abgelaufen | zu viele anfragen | zeitüberschreitung
accès refusé | accès interdit | introuvable | page introuvable | n'existe pas | n'existe plus | indisponible | momentanément indisponible | erreur inattendue | erreur inconnue | une erreur est survenue | erreur interne
erreur du serveur | en maintenance | maintenance en cours | session a expiré | session expirée | trop de requêtes | délai dépassé | une erreur s'est produite
acceso denegado | acceso prohibido | no se encontró la página | página no encontrada | no se ha encontrado | no encontrada | no existe | servicio no disponible | no está disponible | temporalmente no disponible
error inesperado | error desconocido | error del servidor | error interno | se ha producido un error | se produjo un error | algo salió mal | en mantenimiento | mantenimiento programado | sesión ha caducado | sesión ha expirado | demasiadas solicitudes | tiempo de espera agotado
acesso negado | acesso proibido | página não encontrada | não foi encontrada | não foi encontrado | não existe | serviço indisponível | indisponível | temporariamente indisponível | erro inesperado | erro desconhecido | erro do servidor | erro interno
ocorreu um erro | algo deu errado | em manutenção | sessão expirou | sessão expirada | muitas solicitações | tempo esgotado
доступ запрещён | доступ запрещен | отказано в доступе | страница не найдена | не найдена | не найдено | не существует | сервис недоступен | служба недоступна | временно недоступен | временно недоступна | недоступна
произошла ошибка | непредвиденная ошибка | внутренняя ошибка | что-то пошло не так | неизвестная ошибка | ошибка сервера | нет доступа | технические работы | ведутся работы | сеанс истёк | сеанс истек | сессия истекла | слишком много запросов | время ожидания истекло
アクセスが拒否されました | アクセスできません | 見つかりません | 見つかりませんでした | 存在しません | 利用できません | ご利用いただけません | エラーが発生しました | 予期しないエラー | 不明なエラー | サーバーエラー | 問題が発生しました | メンテナンス中 | セッションの有効期限 | タイムアウトしました | 権限がありません
访问被拒绝 | 拒绝访问 | 没有权限 | 无权访问 | 页面不存在 | 页面未找到 | 找不到页面 | 未找到 | 不存在 | 服务不可用 | 暂时不可用 | 暂时无法访问 | 无法访问 | 发生错误 | 发生未知错误 | 未知错误 | 系统错误 | 加载失败 | 网络错误 | 出现错误 | 意外错误 | 出错了 | 服务器错误 | 系统维护 | 维护中 | 会话已过期 | 请求过多 | 请求超时 | 稍后再试 | 稍后重试
""",
    "failure": """
error | fehler | erreur | erro | ошибка | エラー | 错误 | http
""",
    "unable": """
unable to | could not | couldn't | cannot | can't | can not | was not possible to | is not possible to | not able to | failed to
konnte nicht | konnten nicht | kann nicht | können nicht | nicht möglich | konnte | konnten | impossible de | n'avons pas pu | n'a pas pu | n'a pas pu être | ne peut pas | ne pouvons pas | n'arrivons pas à
no se pudo | no pudimos | no podemos | no se puede | no hemos podido | no fue posible | imposible | não foi possível | não conseguimos | não podemos | não pôde ser | impossível
не удалось | не удаётся | не удается | не можем | не смогли | невозможно | できませんでした | できません | 无法 | 不能 | 未能
""",
    "access": """
find what you were looking for | connect to the | show | fetch | open | find | reach | load | display | retrieve | connect | view | page | document | workspace | file | scene | run | report | request | shown
nicht finden | nicht gefunden | nicht laden | nicht geladen | nicht öffnen | nicht anzeigen | angezeigt | seite | dokument | datei | anfrage | finden | laden | geladen | öffnen | anzeigen | abrufen | werden
trouver | charger | ouvrir | afficher | accéder | page | fichier | document | demande | trouvée | chargée | affichée
encontrar | cargar | abrir | mostrar | acceder | página | archivo | documento | solicitud | carregar | exibir | acessar | arquivo | pedido
найти | загрузить | открыть | показать | отобразить | получить | страницу | страница | файл | документ | запрос | ページ | ファイル | 文書 | 表示 | 読み込み | 読み込む | 開く | 見つける | 页面 | 网页 | 文件 | 文档 | 加载 | 打开 | 显示 | 找到
""",
    "script": """
führt kein javascript aus | kein javascript | activation de javascript | nécessite l'activation de javascript | l'activation de javascript | necesita javascript | javascript para funcionar | requires scripts | needs scripts | needs javascript | works only with javascript | braucht javascript | braucht skripte | a besoin de javascript | necesita tener javascript | depende de javascript | relies on javascript | depends on javascript
enable cookies | cookies are disabled | cookies must be enabled | cookies required | accept cookies to continue | javascript support is required | browser does not support javascript | javascript seems to be disabled | javascript appears to be disabled | javascript is not enabled | javascript is turned off | javascript is off | please turn on javascript | please allow javascript | need to enable javascript | noscript
javascript einschalten | ohne javascript | javascript wird benötigt | javascript muss aktiviert | aktivieren sie cookies | javascript ausgeschaltet | unterstützt kein javascript
sans javascript | javascript est nécessaire | activer les cookies | activez les cookies | ne prend pas en charge javascript | javascript désactivé
sin javascript | javascript es necesario | javascript deshabilitado | habilite las cookies | active las cookies | no es compatible con javascript | necesita javascript
sem javascript | javascript é necessário | javascript desabilitado | ative os cookies | habilite os cookies | não suporta javascript | precisa de javascript
без javascript | необходим javascript | javascript выключен | включите cookies | не поддерживает javascript | включите скрипты | включите поддержку
javascriptが必要 | javascript が必要 | javascriptをオン | cookieを有効 | javascriptに対応していません
不支持 javascript | 不支持javascript | javascript 已禁用 | javascript已禁用 | 需要javascript | 需要 javascript | 启用 cookie | 启用cookie
javascript is disabled | javascript is required | javascript required | requires javascript | javascript must be enabled | scripts are blocked | scripts are disabled | scripts must be | only with javascript | without javascript
javascript aktivieren | aktivieren sie javascript | skripte aktivieren | benötigt skripte | benötigt javascript | javascript ist deaktiviert | skripte sind | skripte erlauben | erlauben sie skripte | erfordert javascript
activer javascript | activez javascript | javascript est désactivé | javascript est requis | nécessite javascript | autoriser les scripts | autorisez les scripts | scripts sont bloqués | scripts sont désactivés | besoin de scripts | javascript doit être activé
active javascript | activar javascript | habilite javascript | habilitar javascript | necesita que los scripts | scripts estén permitidos | requiere javascript | javascript está desactivado | permita los scripts | permitir los scripts | necesita scripts | scripts están bloqueados
ative o javascript | ativar o javascript | habilite o javascript | precisa de scripts | requer javascript | javascript está desativado | permita scripts | permitir scripts | scripts ativos | scripts estão bloqueados
включите javascript | включить javascript | разрешите скрипты | разрешите сценарии | javascript отключён | javascript отключен | скрипты отключены | скрипты заблокированы | требуется javascript | нужны скрипты | требуются скрипты
javascript を有効に | javascriptを有効に | スクリプトが無効 | スクリプトを有効 | スクリプトを許可 | javascript が無効 | javascriptが無効 | スクリプトが必要です | スクリプトがブロック
启用 javascript | 启用javascript | 开启 javascript | 开启javascript | 打开 javascript | 禁用了脚本 | 启用脚本 | 允许脚本 | 允许运行脚本 | 脚本被禁用 | 脚本已被禁用 | 需要启用脚本
""",
    "scripts": """
javascript | js | script | scripts | scripting | active scripting | script support | client-side scripts | client-side scripting
skripte | skript | scripte | java-script | les scripts | los scripts | os scripts | скрипты | скриптов | スクリプト | 脚本
""",
    "switch": """
enable | enabled | turn on | turn them on | turned on | switch on | switched on | activate | activated | allow | allowed | unblock | unblocked | permit | permitted | disabled | blocked | switched off | turned off | needs | need | required | requires | require | works only with | only works with | must be
schalten | einschalten | aktivieren | aktiviert | aktiviere | erlauben | zulassen | eingeschaltet | deaktiviert | benötigt | erfordert
activez | activer | activé | autorisez | autoriser | désactivé | nécessite | requiert | habilite | habilita | habilitar | active | activa | activar | activado | permita | permitir | desactivado | requiere | necesita
ative | ativar | ativado | habilitado | desativado | requer | precisa | включите | включить | включён | включен | разрешите | отключён | отключен | требуется | требует | нужен
有効 | 有効に | オン | 許可 | 必要 | 無効 | 启用 | 开启 | 打开 | 允许 | 需要 | 禁用
""",
    "filler": """
your own text | with your own text | texte viendra ici | viendra ici | aquí va | aquí irá | aqui vai | aqui vai o texto | здесь будет | будет здесь | hier kommt | kommt hier | wird ergänzt | in kürze ergänzt | タイトルを入力 | ここに入力 | 填写内容 | 填写标题
to be supplied | to be provided | to be inserted | to be written | goes in here | text follows | copy to come | awaiting text | no content yet | nothing here yet | no text yet
entsteht | folgt noch | wird nachgereicht | text kommt noch | noch kein text
texte à insérer | sera ajouté | pas encore de contenu
texto por añadir | aún no hay contenido | se añadirá
texto a inserir | ainda não há conteúdo | será adicionado
скоро появится | будет добавлен | будет добавлено | пока нет текста
まもなく掲載 | まだありません | 後日追加
即将上线 | 暂无内容 | 待添加
insert content here | insert your text | add your text | add text here | your content here | your title here | your name here | enter text here | type here | write something | this is a placeholder | placeholder content | content placeholder | sample content | dummy content | example text | test page | this is a test | will be replaced | replace this text | replace me | to be determined | to be announced | to be completed | to be added | to be filled in | tbd | tba | more to come | details to follow | stay tuned | fills the page | fill the page | fills the space | fill the space | some text | some words | more words | more text | until somebody writes | until someone writes | replace before | quick brown fox | foo bar | bla bla | under preparation
platzhalter | beispielinhalt | text einfügen | hier text | folgt in kürze | demnächst | in vorbereitung | noch kein inhalt | wird noch ergänzt | mustertext
texte ici | insérer le texte | bientôt disponible | en préparation | à compléter | texte factice
texto aquí | inserte el texto | por completar | en preparación | texto ficticio | contenido de ejemplo
texto aqui | inserir texto | a completar | em preparação | conteúdo de exemplo | texto fictício
текст здесь | вставить текст | скоро будет | в подготовке | пример текста | тестовый текст
ここにテキスト | テキストが入ります | 見本です | 追って掲載 | 近日掲載 | 仮テキスト
这里输入 | 请输入内容 | 内容准备中 | 测试文本 | 测试页面 | 即将推出 | 稍后补充
lorem ipsum | lorem | ipsum | dolor sit amet | your text here | your text goes here | text goes here | heading goes here | title goes here | content goes here | content coming soon | coming soon | content to follow
dummy copy | dummy text | placeholder text | sample text | filler text | to be written | blah | test test | word word | text to come | insert text
blindtext | platzhaltertext | beispieltext | fülltext | inhalt folgt | text folgt | hier steht später | ihr text hier | hier könnte ihr text stehen | wird noch ergänzt
faux texte | texte de remplissage | contenu à venir | texte à venir | votre texte ici | texte provisoire | texte d'exemple
texto de relleno | contenido próximamente | próximamente | su texto aquí | tu texto aquí | escriba aquí | escribe aquí | texto de ejemplo | texto provisional | contenido en preparación
texto de preenchimento | conteúdo em breve | em breve | escreva aqui | seu texto aqui | texto de exemplo | texto provisório
текст-заполнитель | здесь будет текст | текст появится | содержание появится | скоро здесь | ваш текст здесь | введите текст | вставьте текст | образец текста | рыба-текст | заполнитель
ダミーテキスト | ここに本文 | 本文が入ります | 準備中です | サンプルテキスト | テキストを入力 | 近日公開 | 仮のテキスト
占位文字 | 占位文本 | 占位符文本 | 在此处输入 | 此处输入正文 | 内容即将 | 敬请期待 | 示例文本 | 示例文字 | 内容待补充 | 待补充
""",
    "write": """
add | put | paste | drop | write | insert | type | enter | place | describe | fill in
schreiben | schreibe | einfügen | eingeben | eintragen | ergänzen | écrivez | écrire | ajoutez | saisissez | insérez | collez | escriba | escribe | añada | añade | inserte | pegue | introduzca
escreva | adicione | insira | cole | digite | напишите | добавьте | вставьте | введите | впишите | 入力 | 記入 | 書いて | 追加 | 输入 | 填写 | 添加 | 写
""",
    "here": """
here | in this box | in this field | in this space | in this section | in this area | below this line
hier | an dieser stelle | in diesem feld | ici | dans ce champ | à cet endroit | aquí | en este campo | aqui | neste campo | neste espaço | здесь | сюда | тут | в этом поле | в это поле | ここに | ここ | この欄に | 此处 | 这里 | 在此
""",
    "around_error": """
sorry | oops | please | what | looking for | looking | moved | removed | deleted | typed | mistyped | database | message | status | connect | connection | host | gateway | proxy | wrong | happened | reason | details | id | page | pages | requested | asked for | you asked for | document | file | scene | report | reports | workspace | server | portal | site | website | service | app | application | viewer | panel | right now | did not answer | in time | at this time | at the moment | followed | old link | link | links | check | address | url | reload | refresh | try again | later | go back | back | overview | home | homepage | ask | owner | access | permission | permissions | view | contact | administrator | support | help desk | code | reference | request | id | ref | keeps happening | happening | tell | ticket | opened | rendering | slow down | seconds | minutes | sign in | log in | again | go on | continue | expired | moved | on our side | side | failed | timeout | time out | edge | apache | nginx | available | answer | error | problem | may | show | shown | see | load | open | find | reach | fetch | run | display | lookup | address failed | down | maintenance
""",
    "around_script": """
ce site | este sitio | este site | diese seite | funktioniert | fonctionner | funcionar | работать | сайт | site web | sitio web | seite | nécessite | benötigt | necesita | precisa | ihr browser | votre navigateur | su navegador | seu navegador
cookies | security | human | moment | redirect | redirected | just a moment
browser | browsers | nothing happens | if nothing | loading | loads | load | content | properly | correctly | website | work | works | function | functionality | page | report | reports | scene | viewer | panel | app | application | site | reload | refresh | refresh this tab | tab | see | view | show | shown | open | run | continue | go on | again | later | please | settings | experience | best | cookies | newer | use | another | different | blocker | ad blocker | detected | we've detected | switch off | almost there | before | checking | features | support | needed | opens | without it | active | modern | extension | preferences | tool | probe | the rest | interactive
""",
    "around_filler": """
replace | own | your | paragraph | text here | write here | ersetzen | remplacez | reemplace | substitua | замените
short | summary | intro | introduction | main text | text | paragraph | outcome | finding | findings | cause | two | three | lines | sentences | sentence | words | publish | keep it short | keep | heading | title | goes | content | section | box | copy | release | body | caption | description
""",
    "around": """
document | dokument | ver este | ver esta | diesem dokument | ce document | titel | titre | título | заголовок | タイトル | 标题 | absatz | paragraphe | párrafo | parágrafo | абзац
unfortunately | apologies | we apologise | we apologize | regret | kindly | inconvenience | soon | shortly | few minutes | moments | meanwhile | requested page
leider | entschuldigung | entschuldigen | tut uns leid | gewünschte | gesuchte | gewünschten | zurzeit | momentan | bald | kürze | anzusehen | ansehen | besuchen | startseite | administrator
désolé | désolés | malheureusement | excusez | recherchez | cherchez | cherchée | actuellement | bientôt | instant | plus tard | accueil | administrateur | consulter | voir
lo sentimos | disculpe | desafortunadamente | lamentablemente | que busca | busca | buscada | actualmente | pronto | momento | minutos | inicio | administrador | consultar | texto
desculpe | desculpa | lamentamos | infelizmente | que você procura | procura | procurada | atualmente | breve | momento | minutos | início | administrador | acessar | você | visualizar
извините | к сожалению | приносим извинения | просим прощения | запрашиваемая | запрашиваемой | запрошенная | пожалуйста | сейчас | минут | главная | администратор | администратору | просмотра | страницы | здесь | текст
申し訳ございませんが | 申し訳ありません | 恐れ入りますが | お探しの | ご覧になる | ご利用 | しばらく | 後ほど | 少々 | お待ちください | トップページ | 管理者
抱歉 | 对不起 | 很遗憾 | 您要找的 | 您查找的 | 您所 | 目前 | 当前 | 稍等 | 请稍候 | 管理员 | 联系 | 重试 | 再试
bitte | melden | nochmals | noch einmal | anmelden | neu an | seite | angeforderte | dokument | datei | wurde | später | erneut | versuchen | laden | zurück | adresse | prüfen | kennung | dienst | server | browser | anzuzeigen | anzeigen | anwendung | ihr | blockiert | einstellungen | cookies | befund | steht | hier | text | kurze | zusammenfassung | fehler | skripte | javascript | sie | diese | wir | wieder | gegen | verweigert
veuillez | reconnecter | connecter | à nouveau | encore | page | demandée | demandé | document | fichier | plus tard | réessayez | réessayer | recharger | rechargez | retour | adresse | vérifiez | réf | référence | service | serveur | navigateur | afficher | cette page | application | bloque | paramètres | remplacer | résumé | texte | votre | ici | contenu | erreur | scripts | javascript | connexion
inicie | inicia | sesión | de nuevo | otra vez | nuevo | página | solicitada | solicitado | documento | archivo | más tarde | inténtelo | intente | vuelva | recargue | dirección | compruebe | referencia | servicio | servidor | navegador | aplicación | ver | esta página | configuración | bloqueados | texto | aquí | resumen | escriba | contenido | error | scripts | javascript
entre | novamente | outra vez | de novo | página | pedida | solicitada | solicitado | documento | arquivo | ficheiro | mais tarde | tente | recarregue | endereço | verifique | referência | serviço | servidor | navegador | aplicação | aplicativo | ver | esta página | configurações | texto | aqui | resumo | conteúdo | erro | scripts | javascript | seu
для работы | приложения | сайта | работы | неизвестно | войдите | снова | ещё раз | еще раз | страница | страницу | запрошенная | документ | файл | позже | попробуйте | повторите | обновите | адрес | проверьте | код | ссылка | сервис | сервер | браузер | браузере | браузера | увидеть | просмотреть | просмотра | эту | приложение | настройках | текст | здесь | скоро | содержание | ошибка | скрипты | сценарии | javascript | чтобы | этой | для просмотра
このページを表示するには | 表示する | 表示でき | ページ | お探しの | 要求された | ファイル | 文書 | しばらくして | もう一度 | お試しください | 再度 | ログイン | してください | ただいま | 現在 | サーバー | サービス | ブラウザ | ブラウザー | 設定 | アプリ | アプリケーション | これは | です | ここに | 本文 | 入ります | スクリプト | javascript | になっています | エラー | このアプリ
您的浏览器 | 浏览器 | 您访问的 | 请求的 | 页面 | 文件 | 文档 | 无法显示内容 | 无法显示 | 内容 | 查看 | 请 | 重新登录 | 登录 | 刷新 | 返回 | 首页 | 服务器 | 服务 | 设置 | 应用 | 需要 | 此 | 本 | 才能 | 这里是 | 正文 | 文字 | 脚本 | javascript | 抱歉 | 很抱歉 | 错误 | 暂时 | 参考 | 编号 | 以 | 后
""",
}

#: Words that count neither for nor against a notice.
FUNCTION_WORDS = """
a an the and or of to in on at for with from by is are was were be been it its this that these those your you we our i if as not no do does did has have had will can so but because may there they them their which who
der die das den dem des ein eine einen einem einer und oder von zu zum zur in im an am auf für mit aus bei ist sind war wurde werden es sie er wir ihr ihre nicht kein keine wenn als dass
le la les l un une des du de d et ou à au aux en dans sur pour avec par est sont a ont il elle on nous vous ce cette ces que qui ne pas n s se
el los las lo unos unas del al y o en con por para es son está se su sus que no un una como
o os as um uma uns umas do da dos das no na nos nas e ou em com por para é são está se seu sua que não ao à
и или в во на с со к по для от из у о не это эта этот что как мы вы они он она был была было
"""

#: Words by which a sentence shows that it speaks about templates instead of being one.
TALKS_OF_TEMPLATES = """
template | templates | placeholder | placeholders | fills it | fills them | fills them in | filled by | filled in by | is filled | are filled | is replaced | are replaced | expands to | substitutes | substituted | variable | variables | shell | parser | renderer | format string | format strings | syntax | printf | environment | regex | regular expression | escaped | literal | macro | markup | documentation | roman numeral | roman numerals
vorlage | platzhalter | variablen | formular
modèle | gabarit | variables d'environnement | formulaire
plantilla | marcador | formulario
modelo | marcador de posição | formulário
шаблон | шаблоне | шаблона | переменная | переменной | подставляет
ひな形 | テンプレート | 変数 | 書式
模板 | 变量 | 占位符
"""

#: Rows of a keyboard as fingers run over them.
KEY_RUNS = "qwerty asdf sdfg dfgh fghj ghjk hjkl jkl; jkl qwer wert erty rtyu tyui yuio uiop zxcv xcvb cvbn vbnm qwertz asd qwe zxc jklö"

#: Endings of the made-up Latin that fills layouts.
LATIN_ENDINGS = "us um it at et ae unt is ur am em or ibus que isi io quam oris ectus umque eo en ut"

#: Words in square brackets that are no slots: keys, notes of editors and captions.
BRACKETED = """
home | end | enter | return | esc | escape | tab | shift | ctrl | control | alt | delete | insert | backspace | space | up | down | left | right | page up | page down | note | notes | sic | figure | table | citation needed | edit | source | sources | applause | laughter | music | ok | cancel | yes | no | menu | back | next | close | open | save | print | search | help
"""

#: Words that announce a value.
BEFORE_VALUES = """
of from by at on until within than for since near with after before between about under over against via per
von vom bei um am bis seit aus mit nach zwischen gegen über unter
de du des à au depuis dans avec avant après vers jusqu'à entre
del desde hasta con entre hacia
do da dos das em até com desde entre
от до из за по после между около
"""

#: Names of values, which stand in brackets where the value was left out.
VALUE_NAMES = """
date time clock day month year week hour minutes seconds duration name names owner author client customer company team person title subject address street city country phone email number count total amount sum price
percent share rate score value version id index path url link target source file size rows reason cause unit setting
"""
