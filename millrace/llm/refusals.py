"""How a task is declined, as a small grammar for each language: openings, ways to say no, acts, reasons, whole sentences.

Written from general knowledge of the languages, not from any table; a test holds the parts against the tables. Sentences
are put together at random, so that a classifier learns the ways to say no rather than sentences.
"""

from __future__ import annotations

import numpy as np

#: {language: (openings, ways to say no before an act, acts, reasons, sentences that decline as they stand)}; parts by "|".
DECLINE = {
    "en": (
        "Sorry,|I'm so sorry,|Sorry, but|I apologise;|I do apologise, but|My apologies,|Apologies, but|Unfortunately,|Regrettably,|Sadly,|I'm afraid|I am afraid that|With regret,|Thank you, but|No,|I understand, but|Please understand that|As an AI,|As an AI assistant,|As a language model,|Being an assistant,",
        "I can't|I cannot|I can not|I am unable to|I'm unable to|I'm not able to|I am not able to|I won't|I will not|I won't be able to|I must decline to|I have to decline to|I need to decline to|I must refuse to|I have to refuse to|I refuse to|I decline to|I'm not allowed to|I am not allowed to|I'm not permitted to|I am not authorised to|I'm not authorized to|I am not in a position to|I'd rather not|I would prefer not to|I am not comfortable if I|I don't feel able to|I do not wish to|it is not possible for me to|it would be wrong for me to|it would not be appropriate to|I am forbidden to|I can no longer|we can't|we cannot|we are unable to|the assistant cannot|the assistant is not able to",
        "help|help you|help with it|help here|assist|assist you|assist with that|be of assistance|answer|answer it|answer that|answer you|answer your question|answer the prompt|reply|reply to this|respond|respond to that|do it|do so|do what you ask|do as asked|complete it|complete the task|complete what you ask|comply|comply with it|comply with that instruction|fulfil it|fulfill your request|fulfil the task|meet this request|process this|process your request|carry this out|continue|continue with it|proceed|go on|write it|write that|write such a {k}|write a {k} like that|write the {k} you want|produce it|produce a {k}|produce this sort of text|create it|create a {k} on this|generate it|generate this content|provide it|provide a {k}|provide what you want|give you one|give an answer|offer an answer|discuss it|discuss the {n}|discuss such matters|talk about it|talk about the {n}|speak about {x}|comment on it|share it|support it|take part in this|engage with this|handle it|deal with this|accept it|accept the task|take on this task|work on this|say more",
        "as it would break my rules|because my guidelines forbid it|since it conflicts with my guidelines|as my policy does not allow it|because it is against policy|as this is beyond what I may do|for reasons of safety|because it could cause harm|given my instructions|as it falls outside my scope|since I lack the permission|due to my limits|under my rules|because it is not allowed|as that is not permitted",
        "This is a request I decline.|I decline.|I refuse.|I must decline.|I have to refuse.|I have to say no.|I will have to pass on this one.|My rules forbid it.|My guidelines rule this out.|My policy prevents me from doing so.|The policy rules out such a {k}.|That is against my guidelines.|That goes against the rules I follow.|This conflicts with my policy.|Your request violates my guidelines.|Such content is not permitted.|That task is not something I can take on.|That is nothing I can help with.|This is beyond what I am allowed to do.|The request must be turned down.|The task has to be declined.|I'm turning this down.|I have to turn your request down.|I don't feel comfortable with this.|I am not comfortable with that topic.|I'm uncomfortable writing this.|I'm not comfortable answering.|I'd prefer not to go into it.|I have no permission to answer.|There is no way for me to do this.|No answer can be given here.|I will leave this unanswered.|I stop at this point.|Not something I can do.|Not allowed.|Compliance is out of the question.|Request refused.|Can't help with that one.|I won't.|I can't.",
    ),
    "es": (
        "Lo siento,|Lo siento mucho, pero|Perdón,|Perdone, pero|Disculpa,|Disculpe, pero|Lamentablemente,|Por desgracia,|Desafortunadamente,|Me temo que|Con pesar,|Como IA,|Como modelo de lenguaje,|Siendo un asistente,|Entiendo, pero|Lo lamento,|Siento decir que|Mis disculpas,|Con todo respeto,",
        "no puedo|no me es posible|no soy capaz de|no estoy en condiciones de|no tengo permiso para|no estoy autorizado para|no se me permite|debo negarme a|tengo que negarme a|me niego a|debo rechazar|prefiero no|no voy a|no quiero|no debo|no podré|resulta imposible|no me está permitido|no estoy dispuesto a|no tengo autorización para|no me corresponde|debo abstenerme de|tengo que rechazar|declino|me veo obligado a rechazar|soy incapaz de",
        "ayudar|ayudarte|ayudarle con esto|contestar|contestar a eso|responder|responder a la pregunta|responder a tu petición|hacerlo|hacer eso|cumplir la tarea|cumplir tu solicitud|atender la petición|completar la tarea|seguir|continuar con esto|escribirlo|escribir ese texto|escribir algo así|crear ese contenido|dar una respuesta|hablar de ello|hablar de este tema|tratar ese asunto|aceptar la tarea|procesar la solicitud|satisfacer la petición|dar curso a la solicitud|proporcionar una respuesta|ofrecer ayuda|ayudar con este tema|escribir esta historia|redactar la carta|redactar ese contenido|generar este texto|atender tu petición|completar lo que pides|la petición|la tarea|esta solicitud",
        "porque va contra mis normas|ya que mis reglas lo prohíben|por motivos de seguridad|pues no está permitido|debido a mis límites|según mi política",
        "Debo rechazarlo.|Rechazo la tarea.|Tengo que decir que no.|Mis reglas lo impiden.|Mi política lo prohíbe.|Esto va contra mis directrices.|Esa solicitud no está permitida.|No está permitido.|No es algo que pueda hacer.|La petición queda rechazada.|No me siento cómodo con este tema.|Eso queda fuera de lo que puedo hacer.|No puedo.|No lo haré.|Prefiero no responder.|Prefiero no hablar de ello.|No voy a contestar.|Me niego.|Tengo que rechazar la petición.|Esta tarea no es posible para mí.|Lo que pides está prohibido.|Aquí debo parar.",
    ),
    "fr": (
        "Désolé,|Désolée, mais|Pardon,|Toutes mes excuses,|Je m'excuse, mais|Malheureusement,|Hélas,|Je crains que non :|À regret,|En tant qu'IA,|En tant que modèle de langage,|Étant un assistant,|Je comprends, mais|Navré,|Je suis navré, mais|Je vous prie de m'excuser,|Avec regret,|Pardonnez-moi, mais",
        "je ne peux pas|je ne peux|je ne puis|je ne saurais|il m'est impossible de|il ne m'est pas possible de|je suis dans l'incapacité de|je ne suis pas capable de|je n'ai pas le droit de|je ne suis pas autorisé à|il ne m'est pas permis de|je dois refuser de|je me vois obligé de refuser de|je refuse de|je préfère ne pas|je ne vais pas|je ne veux pas|je ne pourrai pas|je ne suis pas en mesure de|je ne suis pas disposé à|je n'ai pas l'autorisation de|il m'est interdit de|je dois m'abstenir de|je dois décliner|je décline|je dois refuser|il n'est pas possible pour moi de",
        "aider|vous aider|t'aider à cela|répondre|répondre à cela|répondre à votre question|répondre à ta demande|le faire|faire cela|faire ce que vous demandez|accomplir la tâche|satisfaire la demande|traiter la demande|continuer|poursuivre|l'écrire|écrire un tel texte|rédiger cela|produire ce contenu|créer ce contenu|donner une réponse|en parler|parler de ce sujet|aborder ce sujet|accepter la tâche|donner suite à la demande|accéder à votre requête|fournir une réponse|apporter mon aide|aider pour cela|écrire cette histoire|rédiger la lettre|écrire ce texte-là|générer ce texte|exécuter la tâche|faire ce travail|la demande|la tâche|cette requête",
        "car cela va contre mes règles|parce que mes consignes l'interdisent|pour des raisons de sécurité|car ce n'est pas permis|en raison de mes limites|selon ma politique",
        "Je dois refuser.|Je refuse la tâche.|Je dois dire non.|Mes règles l'interdisent.|Ma politique s'y oppose.|Cela va à l'encontre de mes consignes.|Cette demande n'est pas autorisée.|Ce n'est pas permis.|Ce n'est pas une chose que je peux faire.|La demande est refusée.|Je ne suis pas à l'aise avec ce sujet.|Cela dépasse ce que je peux faire.|Cela m'est défendu.|Je ne le ferai pas.|Je préfère ne pas répondre.|Je préfère ne pas en parler.|Je ne répondrai pas.|Je refuse.|La réponse est non.|Je dois décliner la demande.|Cette tâche m'est impossible.|Ce que vous demandez est interdit.|Je m'arrête ici.",
    ),
    "de": (
        "Tut mir leid,|Es tut mir sehr leid, aber|Verzeihung,|Entschuldigung,|Entschuldigen Sie, aber|Leider|Bedauerlicherweise|Ich fürchte,|Mit Bedauern:|Als KI|Als Sprachmodell|Als ein Assistent|Ich verstehe das, aber|Sorry,|Ich bedaure,|Ich bitte um Entschuldigung,|Mit allem Respekt,|Es tut mir leid,",
        "ich kann nicht|kann ich nicht|ich darf nicht|darf ich nicht|ich bin nicht in der Lage,|es ist mir nicht möglich,|mir ist es nicht erlaubt,|es ist mir nicht gestattet,|ich bin nicht befugt,|ich muss es ablehnen,|ich lehne es ab,|ich weigere mich,|ich möchte nicht|ich werde nicht|ich will nicht|ich muss davon absehen,|ich kann leider nicht|leider darf ich nicht|dazu kann ich nicht|dabei darf ich nicht|ich bin nicht bereit,|ich habe keine Erlaubnis,|es ist mir untersagt,|ich muss darauf verzichten,|ich muss mich weigern,|mir ist nicht erlaubt,|ich sehe mich außerstande,",
        "helfen|Ihnen helfen|dir dabei helfen|dabei zu helfen|weiterhelfen|antworten|darauf antworten|darauf zu antworten|die Frage beantworten|diese Frage zu beantworten|das tun|das zu tun|die Aufgabe erledigen|die Aufgabe zu lösen|der Bitte nachkommen|dem nachzukommen|die Anfrage bearbeiten|fortfahren|weiterzumachen|so etwas schreiben|das zu schreiben|den Text verfassen|solche Inhalte erstellen|eine Antwort geben|darüber sprechen|über dieses Thema zu sprechen|die Aufgabe annehmen|eine Antwort geben|eine Antwort zu geben|diesen Wunsch erfüllen|den Wunsch zu erfüllen|die Bitte erfüllen|der Bitte zu entsprechen|der Aufforderung folgen|behilflich sein|Hilfe leisten|die Geschichte schreiben|den Brief zu schreiben|solch einen Text schreiben|diesen Inhalt zu erzeugen|die Aufgabe ausführen|die Aufgabe abzuschließen",
        "weil es gegen meine Regeln verstößt|da meine Vorgaben es verbieten|aus Gründen der Sicherheit|weil es nicht erlaubt ist|wegen meiner Grenzen|nach meinen Richtlinien",
        "Ich muss ablehnen.|Ich lehne ab.|Da muss ich nein sagen.|Meine Regeln verbieten es.|Meine Vorgaben lassen das nicht zu.|Das verstößt gegen meine Richtlinien.|Diese Bitte ist nicht zulässig.|Das ist nicht erlaubt.|Das ist nichts, was ich tun kann.|Die Anfrage wird abgelehnt.|Mir ist bei diesem Thema nicht wohl.|Das übersteigt, was ich darf.|Das kann ich nicht.|Das mache ich nicht.|Das werde ich nicht tun.|Ich möchte lieber nicht antworten.|Darüber spreche ich nicht.|Darauf antworte ich nicht.|Ich weigere mich.|Hier muss ich passen.|Ich muss die Anfrage ablehnen.|Ich kann keine Antwort geben.|Diese Aufgabe ist mir nicht möglich.|Worum Sie bitten, ist verboten.|An dieser Stelle höre ich auf.",
    ),
    "it": (
        "Scusa,|Scusami, ma|Chiedo scusa,|Mi spiace molto, ma|Mi dispiace,|Sfortunatamente,|Purtroppo|Temo che|Con rammarico,|In quanto IA,|In quanto modello linguistico,|Essendo un assistente,|Capisco, ma|Sono spiacente,|Mi scusi, ma|Le mie scuse,|Con tutto il rispetto,",
        "non posso|non mi è possibile|non riesco a|non sono in grado di|non sono capace di|non ho il permesso di|non sono autorizzato a|non mi è permesso|non mi è consentito|devo rifiutarmi di|mi rifiuto di|devo rifiutare di|preferisco non|non intendo|non voglio|non potrò|non sono disposto a|non ho l'autorizzazione a|mi è vietato|devo astenermi dal|devo declinare|declino|devo rifiutare|mi trovo costretto a rifiutare|non sono nella posizione di",
        "aiutare|aiutarti|aiutarla in questo|rispondere|rispondere a ciò|rispondere alla domanda|farlo|fare questo|fare quanto chiesto|svolgere il compito|soddisfare la richiesta|elaborare la richiesta|continuare|proseguire|scriverlo|scrivere un testo simile|creare tali contenuti|dare una risposta|parlarne|parlare di questo argomento|trattare il tema|accettare il compito|dare seguito alla richiesta|accogliere la richiesta|fornire una risposta|offrire aiuto|essere d'aiuto|scrivere questa storia|redigere la lettera|generare questo testo|completare quanto chiedi|portare a termine il compito|la richiesta|il compito|questa domanda",
        "perché va contro le mie regole|poiché le mie linee guida lo vietano|per motivi di sicurezza|perché non è permesso|a causa dei miei limiti|secondo la mia politica",
        "Devo rifiutare.|Rifiuto il compito.|Devo dire di no.|Le mie regole lo vietano.|La mia politica lo impedisce.|Ciò va contro le mie linee guida.|Questa richiesta non è consentita.|Non è permesso.|Non è qualcosa che posso fare.|La richiesta è respinta.|Non mi sento a mio agio con questo tema.|Questo va oltre ciò che posso fare.|Non posso.|Non lo farò.|Preferisco non rispondere.|Preferisco non parlarne.|Non risponderò.|Mi rifiuto.|La risposta è no.|Devo respingere la richiesta.|Questo compito mi è impossibile.|Ciò che chiedi è vietato.|Mi fermo qui.",
    ),
    "pt": (
        "Desculpe,|Desculpa, mas|Peço desculpa,|Lamento muito, mas|Sinto muito,|Infelizmente,|Lamentavelmente,|Receio que|Com pesar,|Sendo uma IA,|Como modelo de linguagem,|Sendo um assistente,|Compreendo, mas|As minhas desculpas,|Perdão, mas|Com todo o respeito,|Lamento,",
        "não posso|não me é possível|não consigo|não sou capaz de|não estou em condições de|não tenho permissão para|não estou autorizado a|não me é permitido|devo recusar-me a|tenho de recusar|preciso recusar|recuso-me a|prefiro não|não vou|não quero|não poderei|não estou disposto a|não tenho autorização para|estou proibido de|devo abster-me de|devo recusar|recuso|declino|vejo-me obrigado a recusar|sou incapaz de|não me cabe",
        "ajudar|ajudá-lo|ajudar você com isso|responder|responder a isso|responder à pergunta|fazê-lo|fazer isso|fazer o que pede|cumprir a tarefa|atender ao pedido|processar o pedido|continuar|prosseguir|escrevê-lo|escrever um texto assim|criar esse conteúdo|dar uma resposta|falar disso|falar sobre esse assunto|tratar do tema|aceitar a tarefa|dar seguimento ao pedido|satisfazer o pedido|fornecer uma resposta|oferecer ajuda|ajudar nesse assunto|escrever esta história|redigir a carta|gerar este texto|completar o que pede|concluir a tarefa|o pedido|a tarefa|esta solicitação",
        "porque vai contra as minhas regras|pois as minhas normas o proíbem|por motivos de segurança|porque não é permitido|devido aos meus limites|segundo a minha política",
        "Devo recusar.|Recuso a tarefa.|Tenho de dizer que não.|As minhas regras proíbem isso.|A minha política impede isso.|Isso vai contra as minhas normas.|Esse pedido não é permitido.|Não é permitido.|Não é algo que eu possa fazer.|O pedido foi recusado.|Não me sinto à vontade com esse tema.|Isso vai além do que posso fazer.|Não posso.|Não o farei.|Prefiro não responder.|Prefiro não falar disso.|Não vou responder.|Recuso-me.|A resposta é não.|Tenho de rejeitar o pedido.|Esta tarefa é-me impossível.|O que pede é proibido.|Fico por aqui.",
    ),
    "ru": (
        "Извините,|Простите,|Прошу прощения,|Мне очень жаль, но|Мне жаль,|К сожалению,|Увы,|Боюсь, что|С сожалением сообщаю:|Как ИИ,|Как языковая модель,|Будучи помощником,|Я понимаю, но|Приношу извинения,|Мне очень жаль,|При всём уважении,|Сожалею, но",
        "я не могу|не могу|я не в состоянии|я не способен|мне нельзя|мне не позволено|мне запрещено|мне не разрешается|я не имею права|я не вправе|я не уполномочен|я вынужден отказаться|я должен отказаться|я отказываюсь|я предпочту не|я не буду|я не стану|я не хочу|я не смогу|я не готов|я не намерен|у меня нет разрешения|я обязан отказаться|я воздержусь и не буду|я отклоняю|мне приходится отклонить|мне не положено|для меня невозможно",
        "помочь|вам помочь|помочь с этим|ответить|отвечать|ответить на это|ответить на вопрос|отвечать на него|это сделать|сделать это|выполнить задание|выполнять его|выполнить просьбу|обработать запрос|продолжать|продолжить|написать это|писать такой текст|создавать такое|дать ответ|говорить об этом|обсуждать эту тему|принять задание|удовлетворить просьбу|дать ответ на это|оказать помощь|помогать с этим|написать этот рассказ|составить письмо|создать этот текст|исполнить просьбу|справиться с заданием|завершить задание|просьбу|запрос|это задание",
        "так как это против моих правил|потому что правила это запрещают|из соображений безопасности|ведь это не разрешено|из-за моих ограничений|согласно моей политике",
        "Я должен отказаться.|Я отказываюсь.|Приходится отказать.|Мои правила это запрещают.|Моя политика этого не допускает.|Это противоречит моим правилам.|Такая просьба недопустима.|Это не разрешено.|Этого я сделать не могу.|Запрос отклонён.|Мне неловко говорить на эту тему.|Это выходит за рамки того, что мне можно.|Не могу.|Я этого не сделаю.|Я предпочту не отвечать.|Я не буду об этом говорить.|Отвечать не стану.|Мой ответ — нет.|Приходится отклонить просьбу.|Это задание для меня невозможно.|То, о чём вы просите, запрещено.|На этом я остановлюсь.",
    ),
    "ar": (
        "آسف،|أنا آسف،|أعتذر،|أعتذر منك، لكن|عذرا،|معذرة،|للأسف،|مع الأسف،|أخشى أنني|بكل أسف،|كوني مساعدا،|بصفتي نموذجا لغويا،|أفهم ذلك، لكن|أقدم اعتذاري،|أنا آسف جدا،|مع كامل الاحترام،|يؤسفني أنني",
        "لا أستطيع|لا أقدر على|لا يمكنني|لا يمكن لي|لست قادرا على|لا يسمح لي|غير مسموح لي|لا يحق لي|ليس لدي إذن|علي أن أرفض|أرفض|يجب أن أرفض|لن أستطيع|لن أتمكن من|لا أريد|أفضل ألا|لست مستعدا ل|ليس مسموحا لي ب|أنا ممنوع من|علي الامتناع عن|أنا مضطر لرفض|لا بد لي من رفض|لا أملك إذنا ل|من غير الممكن لي",
        "المساعدة|مساعدتك|المساعدة في ذلك|الإجابة|الإجابة عن السؤال|الرد|الرد على ذلك|فعل ذلك|القيام بذلك|القيام بهذه المهمة|تنفيذ المهمة|تنفيذ ما تطلب|تلبية الطلب|معالجة الطلب|المتابعة|الاستمرار|كتابة ذلك|كتابة نص كهذا|إنشاء هذا المحتوى|إعطاء جواب|الحديث عن ذلك|مناقشة هذا الموضوع|قبول المهمة|تقديم جواب|تقديم المساعدة|تحقيق الطلب|تنفيذ هذا الأمر|كتابة هذه القصة|كتابة الرسالة|إكمال المهمة|إنجاز ما طلبت|هذا الطلب|هذه المهمة",
        "لأن ذلك يخالف قواعدي|لأن القواعد تمنع ذلك|لأسباب تتعلق بالسلامة|فهذا غير مسموح|بسبب حدودي|وفق سياستي",
        "علي أن أعتذر.|أرفض المهمة.|لا بد أن أقول لا.|قواعدي تمنع ذلك.|سياستي لا تسمح بذلك.|هذا يخالف إرشاداتي.|هذا الطلب غير مسموح به.|هذا غير مسموح.|ليس هذا شيئا يمكنني فعله.|تم رفض الطلب.|لا أرتاح لهذا الموضوع.|هذا خارج ما يمكنني فعله.|لا أستطيع.|لن أفعل ذلك.|أفضل عدم الإجابة.|لن أتحدث عن هذا.|لن أجيب.|أرفض ذلك.|جوابي هو لا.|يجب رفض هذا الطلب.|هذه المهمة مستحيلة علي.|ما تطلبه ممنوع.|أتوقف هنا.",
    ),
    "zh": (
        "抱歉，|很抱歉，|对不起，|非常对不起，|不好意思，|遗憾的是，|很遗憾，|恐怕|作为人工智能，|作为语言模型，|身为助手，|我理解，但是|抱歉地说，|请原谅，|恕我直言，|十分抱歉，",
        "我不能|我无法|我没法|我不可以|我不便|我无权|我不被允许|我没有权限|我未获授权|我必须拒绝|我只能拒绝|我拒绝|我不愿|我不会|我不想|我没有办法|恕我不能|恕难|我不愿意|我没有能力|我不适合|我被禁止|我必须谢绝|我只好谢绝|我谢绝|我没有授权",
        "帮忙|帮助你|帮助您做这件事|协助|提供协助|回答|回答这个|回答您的问题|回应|作出回答|这样做|做这件事|完成任务|完成您的要求|满足这个要求|处理您的请求|继续|继续下去|写这个|写这样的文字|撰写这种内容|生成这些内容|提供答案|谈论这个|讨论这个话题|接受这项任务|从命|满足您的请求|给出回答|给予帮助|帮您处理|写这个故事|写这封信|写出这样的内容|完成您交代的事|执行这个任务|这个请求|这项要求",
        "因为这违反我的规则|因为规则禁止这样做|出于安全考虑|因为这不被允许|由于我的限制|根据我的政策",
        "我必须拒绝。|我拒绝这项任务。|我只能说不。|我的规则禁止这样做。|我的政策不允许。|这违反了我的准则。|这个请求不被允许。|这是不允许的。|这不是我能做的事。|请求已被拒绝。|我不方便谈这个话题。|这超出了我能做的范围。|我做不到。|我不会这样做。|我宁愿不回答。|我不想谈这个。|我不会回答。|我拒绝。|我的回答是不。|这个请求我必须谢绝。|这项任务对我来说不可能。|您所要求的是被禁止的。|我就说到这里。",
    ),
}
KINDS = "sonnet ballad article column memoir proposal briefing tutorial limerick parable overview interview blurb recipe handout headline caption statement".split()
#: What is said around a refusal.
LEAD = {
    "en": "Hi there!|Hey!|Dear reader,|Thanks for reaching out.|Thank you for the question about the {n}.|I appreciate your interest in {x}.|I know how much this means to you.|You are asking for a {k}.|I read your request with care.|What a thoughtful request.",
    "es": "¡Buenas!|Te agradezco la pregunta.|Sé que esto te importa.", "fr": "Salut !|Je vous remercie de la question.", "de": "Guten Tag!|Ich danke Ihnen für die Frage.", "it": "Salve!|La ringrazio della domanda.", "pt": "Oi!|Agradeço a pergunta.", "ru": "Добрый день!|Благодарю за вопрос.", "ar": "أهلا!|أشكرك على السؤال.", "zh": "您好！|感谢您的提问。",
}
TRAIL = {
    "en": "I hope you understand.|Thanks for your patience.|Feel free to ask about something else.|I'd be glad to help with another topic.|Perhaps an expert could advise you.|If you like, I could try a {k} on another subject.|Is there something different I can do for you?|You may want to look elsewhere for it.|Please try a different question.|Best wishes.",
    "es": "Espero que lo comprendas.|Puedo ayudar con otro tema.|Pregunta otra cosa, por favor.", "fr": "J'espère que vous comprenez.|Je peux aider sur un autre sujet.|Posez-moi une autre question.", "de": "Ich hoffe auf Ihr Verständnis.|Bei anderen Themen helfe ich gern.|Fragen Sie mich bitte etwas anderes.", "it": "Spero che tu capisca.|Posso aiutare con un altro tema.|Chiedimi pure altro.", "pt": "Espero que compreenda.|Posso ajudar com outro assunto.|Pergunte outra coisa, por favor.", "ru": "Надеюсь на понимание.|Могу помочь с другой темой.|Задайте другой вопрос.", "ar": "أرجو أن تتفهم ذلك.|يمكنني المساعدة في موضوع آخر.|اسألني سؤالا آخر.", "zh": "希望您能理解。|我可以在别的话题上帮忙。|请换一个问题。",
}
#: Answers that only sound like a refusal: stories, quotations, letters, news.
SOUNDS_LIKE = "Dear {x}, we are sorry to say that the {n} was sold last week.|“Sorry, I cannot come to the {n} today,” {x} told the children.|“I won't help you with the {n},” she shouted across the yard.|{x} could not find the {a} {n} anywhere.|Nobody was able to open the {n} before dusk.|The {n} cannot be moved without the keeper's leave.|The council declined to pay for the {a} {n}.|The guard refused to let {x} near the {n}.|He was not allowed to touch the {n}.|We regret the delay of the {n} and thank you for waiting.|It is not possible to see {x} from the {n}.|Unfortunately for {x}, the {n} had been {a} all along.|The rules of the {n} do not allow dogs.|Visitors are not permitted to enter the {a} {n} after six.|The shop apologised for the {a} {n} and sent another.|You cannot judge a {n} by its colour.|My grandmother would not talk about the {n}.|As a guide, I never tire of the {n}.|I can't wait to see the {a} {n} again."
PLAIN = "Yes.|No.|Right.|True.|False.|Yes, it does.|No, not at all.|Seventeen.|About nine in all.|The {n}.|A {a} {n}.|It was {x}.|By the {n}, mostly.|Gladly, here it comes.|Certainly, see the lines below.|With pleasure.|That holds for every {n}.|I would say so.|Most likely the {n}.|The result is seventeen.|Here you are: a {a} {n}.|Yes, I can do that.|Sure, I can help.|I can give you a {k} at once.|I will write about the {n}.|This was a simple task.|Your {k} now follows.|Anyone may use the {n}.|I was glad to look into it.|Ask about {x} whenever you wish.|Everything is allowed here."
NOUNS = "anchor barrel cellar drum fence glove hammer island jacket kettle lantern mirror needle orchard pillow quarry".split()
ADJECTIVES = "rusty mild crooked silent heavy bright dusty gentle wooden empty".split()
NAMES = "Abelard Brunhild Casimir Dorothea Eustace Fiametta Gustav Hedwig".split()
ASIDE = ("Reply:", "My reply:", "Task:", "Instruction:", "So:", "Antwort:", "Respuesta:", "Ответ:", "答：")


def _pick(rng: np.random.Generator, parts: str) -> str:
    options = parts.split("|")
    return options[rng.integers(len(options))]


def decline(rng: np.random.Generator, lang: str) -> list[str]:
    """One or two sentences that decline a task, put together at random."""
    opening, no, act, why, whole = DECLINE[lang]
    gap = "" if lang == "zh" else " "
    stop = "。" if lang == "zh" else "."
    if rng.random() < 0.35:
        text = _pick(rng, whole)
        if rng.random() < 0.35:
            text = _pick(rng, opening) + gap + text
    else:
        text = _pick(rng, no) + gap + _pick(rng, act)
        if rng.random() < 0.6:
            text = _pick(rng, opening) + gap + text
        if rng.random() < 0.35:
            text += (", " if rng.random() < 0.5 else gap) + _pick(rng, why) if lang != "zh" else "，" + _pick(rng, why)
        text = text[0].upper() + text[1:] + stop
    out = [text]
    if rng.random() < 0.25:
        more = _pick(rng, whole if rng.random() < 0.6 else why)
        more = more[0].upper() + more[1:]
        out.append(more if more[-1] in ".。" else more + stop)
    return out


def phrases(lang: str) -> list[str]:
    """All parts that speak for a refusal in themselves: ways to say no with a few acts, reasons, whole sentences."""
    _, no, act, why, whole = DECLINE[lang]
    gap = "" if lang == "zh" else " "
    acts = act.split("|")
    return [n + gap + acts[(7 * i + j) % len(acts)] for i, n in enumerate(no.split("|")) for j in range(3)] + why.split("|") + whole.split("|")
