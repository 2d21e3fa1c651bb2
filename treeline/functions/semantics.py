"""What a call's name says about it, by domain, language and framework: the reference's seven domain files.

A row is `operation target: pattern pattern ...`; target is where the operated thing stands (first_arg, receiver or none); * stands for any
text, and a pattern after ~ is a regular expression. The order is that of the files, and the first pattern that fits is taken.
"""

from __future__ import annotations


def _patterns(domain: str, language: str, framework: str, rows: str) -> list[tuple[str, str, str, str, str, str]]:
    """(domain, framework, pattern, operation, language, target) of every pattern."""
    out = []
    for line in rows.strip().splitlines():
        head, _, names = line.partition(": ")
        operation, target = head.split()
        out += [(domain, framework, name, operation, language, target) for name in names.split()]
    return out


# Fixed values.
REFERENCE = (
    _patterns("db", "elixir", "ecto", r"""
retrieve first_arg: Repo.get Repo.get! Repo.get_by Repo.get_by! Repo.one Repo.one!
retrieve_all first_arg: Repo.all
create none: Repo.insert Repo.insert!
create first_arg: Repo.insert_all
create none: Repo.insert_or_update Repo.insert_or_update!
update none: Repo.update Repo.update!
update first_arg: Repo.update_all
delete none: Repo.delete Repo.delete!
delete first_arg: Repo.delete_all
transaction none: Repo.transaction
preload none: Repo.preload
aggregate first_arg: Repo.aggregate
query first_arg: Repo.exists?
query none: Ecto.Query.from
retrieve first_arg: *.Repo.get *.Repo.get!
retrieve_all first_arg: *.Repo.all
retrieve first_arg: *.Repo.one
create none: *.Repo.insert *.Repo.insert!
update none: *.Repo.update *.Repo.update!
delete none: *.Repo.delete *.Repo.delete!
transaction none: *.Repo.transaction
preload none: *.Repo.preload
""")
    + _patterns("db", "python", "django", r"""
retrieve receiver: ~\.objects\.get\b ~\.objects\.get_or_create\b
query receiver: ~\.objects\.filter\b ~\.objects\.exclude\b
retrieve_all receiver: ~\.objects\.all\b
retrieve receiver: ~\.objects\.first\b ~\.objects\.last\b
create receiver: ~\.objects\.create\b ~\.objects\.bulk_create\b
update receiver: ~\.objects\.update\b
delete receiver: ~\.objects\.delete\b
aggregate receiver: ~\.objects\.count\b ~\.objects\.aggregate\b
preload receiver: ~\.objects\.select_related\b ~\.objects\.prefetch_related\b
update receiver: ~\.save\b
delete receiver: ~\.delete\b
""")
    + _patterns("db", "python", "sqlalchemy", r"""
query first_arg: session.query
create first_arg: session.add
create none: session.add_all
delete first_arg: session.delete
update first_arg: session.merge
transaction none: session.commit session.rollback session.flush
retrieve none: ~^[^.]+\.get$ ~^[^.]+\.first$ ~^[^.]+\.one$
retrieve_all none: ~^[^.]+\.all$
query none: ~^[^.]+\.filter$ ~^[^.]+\.filter_by$
aggregate none: ~^[^.]+\.count$
""")
    + _patterns("db", "ruby", "activerecord", r"""
retrieve receiver: *.find *.find_by *.find_by! *.find_or_create_by *.find_or_initialize_by *.first *.last *.take
retrieve_all receiver: *.all
query receiver: *.where *.select *.joins
preload receiver: *.includes *.eager_load *.preload
create receiver: *.create *.create! *.new *.insert_all
update receiver: *.update *.update! *.update_all
update none: *.save *.save!
delete none: *.destroy *.destroy!
delete receiver: *.destroy_all
delete none: *.delete
delete receiver: *.delete_all
aggregate receiver: *.count *.sum *.average *.minimum *.maximum
transaction none: *.transaction
""")
    + _patterns("db", "javascript", "sequelize", r"""
retrieve receiver: *.findByPk *.findOne
retrieve_all receiver: *.findAll *.findAndCountAll
retrieve receiver: *.findOrCreate
create receiver: *.create *.bulkCreate
update receiver: *.update
update none: *.save
delete receiver: *.destroy
aggregate receiver: *.count *.max *.min *.sum
""")
    + _patterns("db", "javascript", "typeorm", r"""
retrieve none: *.findOne *.findOneBy *.findOneOrFail
retrieve_all none: *.find *.findBy *.findAndCount
create none: *.save *.insert
update none: *.update
delete none: *.delete *.remove
query first_arg: *.createQueryBuilder
transaction none: *.transaction
""")
    + _patterns("db", "javascript", "prisma", r"""
retrieve receiver: *.findUnique *.findUniqueOrThrow *.findFirst *.findFirstOrThrow
retrieve_all receiver: *.findMany
create receiver: *.create *.createMany
update receiver: *.update *.updateMany *.upsert
delete receiver: *.delete *.deleteMany
aggregate receiver: *.count *.aggregate *.groupBy
transaction none: $transaction
""")
    + _patterns("http", "elixir", "httpoison", r"""
get first_arg: HTTPoison.get HTTPoison.get!
post first_arg: HTTPoison.post HTTPoison.post!
put first_arg: HTTPoison.put HTTPoison.put!
patch first_arg: HTTPoison.patch HTTPoison.patch!
delete first_arg: HTTPoison.delete HTTPoison.delete!
head first_arg: HTTPoison.head HTTPoison.head!
options first_arg: HTTPoison.options HTTPoison.options!
request none: HTTPoison.request HTTPoison.request!
""")
    + _patterns("http", "elixir", "req", r"""
get first_arg: Req.get Req.get!
post first_arg: Req.post Req.post!
put first_arg: Req.put Req.put!
patch first_arg: Req.patch Req.patch!
delete first_arg: Req.delete Req.delete!
head first_arg: Req.head Req.head!
request none: Req.request Req.request! Req.new
""")
    + _patterns("http", "elixir", "tesla", r"""
get first_arg: Tesla.get Tesla.get!
post first_arg: Tesla.post Tesla.post!
put first_arg: Tesla.put Tesla.put!
patch first_arg: Tesla.patch Tesla.patch!
delete first_arg: Tesla.delete Tesla.delete!
head first_arg: Tesla.head Tesla.head!
options first_arg: Tesla.options Tesla.options!
request none: Tesla.request
""")
    + _patterns("http", "elixir", "finch", r"""
request none: Finch.request Finch.request!
stream none: Finch.stream Finch.stream!
request none: Finch.build
""")
    + _patterns("http", "python", "requests", r"""
get first_arg: requests.get
post first_arg: requests.post
put first_arg: requests.put
patch first_arg: requests.patch
delete first_arg: requests.delete
head first_arg: requests.head
options first_arg: requests.options
request none: requests.request
get first_arg: session.get
post first_arg: session.post
put first_arg: session.put
patch first_arg: session.patch
delete first_arg: session.delete
head first_arg: session.head
request none: session.request
""")
    + _patterns("http", "python", "httpx", r"""
get first_arg: httpx.get
post first_arg: httpx.post
put first_arg: httpx.put
patch first_arg: httpx.patch
delete first_arg: httpx.delete
head first_arg: httpx.head
options first_arg: httpx.options
request none: httpx.request
stream first_arg: httpx.stream
get first_arg: client.get
post first_arg: client.post
put first_arg: client.put
patch first_arg: client.patch
delete first_arg: client.delete
head first_arg: client.head
request none: client.request
stream first_arg: client.stream
""")
    + _patterns("http", "python", "aiohttp", r"""
get first_arg: ~\.get$
post first_arg: ~\.post$
put first_arg: ~\.put$
patch first_arg: ~\.patch$
delete first_arg: ~\.delete$
head first_arg: ~\.head$
options first_arg: ~\.options$
request none: ~\.request$ aiohttp.ClientSession
""")
    + _patterns("http", "ruby", "nethttp", r"""
get first_arg: Net::HTTP.get Net::HTTP.get_response
post first_arg: Net::HTTP.post Net::HTTP.post_form
request none: Net::HTTP.start
get first_arg: ~\.get$
post first_arg: ~\.post$
put first_arg: ~\.put$
patch first_arg: ~\.patch$
delete first_arg: ~\.delete$
head first_arg: ~\.head$
request none: ~\.request$
""")
    + _patterns("http", "ruby", "httparty", r"""
get first_arg: HTTParty.get
post first_arg: HTTParty.post
put first_arg: HTTParty.put
patch first_arg: HTTParty.patch
delete first_arg: HTTParty.delete
head first_arg: HTTParty.head
options first_arg: HTTParty.options
""")
    + _patterns("http", "ruby", "faraday", r"""
get first_arg: Faraday.get
post first_arg: Faraday.post
put first_arg: Faraday.put
patch first_arg: Faraday.patch
delete first_arg: Faraday.delete
head first_arg: Faraday.head
options first_arg: Faraday.options
request none: Faraday.new
get first_arg: conn.get
post first_arg: conn.post
put first_arg: conn.put
patch first_arg: conn.patch
delete first_arg: conn.delete
head first_arg: conn.head
""")
    + _patterns("http", "ruby", "restclient", r"""
get first_arg: RestClient.get
post first_arg: RestClient.post
put first_arg: RestClient.put
patch first_arg: RestClient.patch
delete first_arg: RestClient.delete
head first_arg: RestClient.head
options first_arg: RestClient.options
""")
    + _patterns("http", "javascript", "fetch", r"""
request first_arg: fetch window.fetch globalThis.fetch
""")
    + _patterns("http", "javascript", "axios", r"""
get first_arg: axios.get
post first_arg: axios.post
put first_arg: axios.put
patch first_arg: axios.patch
delete first_arg: axios.delete
head first_arg: axios.head
options first_arg: axios.options
request none: axios.request
request first_arg: axios
get first_arg: instance.get
post first_arg: instance.post
put first_arg: instance.put
patch first_arg: instance.patch
delete first_arg: instance.delete
head first_arg: instance.head
request none: instance.request
""")
    + _patterns("http", "javascript", "got", r"""
request first_arg: got
get first_arg: got.get
post first_arg: got.post
put first_arg: got.put
patch first_arg: got.patch
delete first_arg: got.delete
head first_arg: got.head
stream first_arg: got.stream
request none: got.extend
""")
    + _patterns("http", "javascript", "superagent", r"""
get first_arg: superagent.get
post first_arg: superagent.post
put first_arg: superagent.put
patch first_arg: superagent.patch
delete first_arg: superagent.delete
head first_arg: superagent.head
get first_arg: request.get
post first_arg: request.post
put first_arg: request.put
patch first_arg: request.patch
delete first_arg: request.delete
head first_arg: request.head
""")
    + _patterns("auth", "elixir", "guardian", r"""
generate_token first_arg: Guardian.encode_and_sign
verify_token first_arg: Guardian.decode_and_verify Guardian.resource_from_token
logout first_arg: Guardian.revoke
refresh_token none: Guardian.refresh
login first_arg: Guardian.Plug.sign_in
logout none: Guardian.Plug.sign_out
authenticate none: Guardian.Plug.current_resource Guardian.Plug.authenticated?
generate_token first_arg: *.Guardian.encode_and_sign
verify_token first_arg: *.Guardian.decode_and_verify
""")
    + _patterns("auth", "elixir", "pow", r"""
authenticate none: Pow.Plug.authenticate_user
register none: Pow.Plug.create_user
authenticate none: Pow.Plug.update_user
logout none: Pow.Plug.delete_user
authenticate none: Pow.Plug.current_user Pow.Operations.authenticate
register none: Pow.Operations.create
""")
    + _patterns("auth", "elixir", "bcrypt_elixir", r"""
hash_password first_arg: Bcrypt.hash_pwd_salt
verify_password first_arg: Bcrypt.verify_pass
verify_password none: Bcrypt.no_user_verify
""")
    + _patterns("auth", "elixir", "argon2_elixir", r"""
hash_password first_arg: Argon2.hash_pwd_salt
verify_password first_arg: Argon2.verify_pass
verify_password none: Argon2.no_user_verify
""")
    + _patterns("auth", "elixir", "pbkdf2_elixir", r"""
hash_password first_arg: Pbkdf2.hash_pwd_salt
verify_password first_arg: Pbkdf2.verify_pass
""")
    + _patterns("auth", "elixir", "comeonin", r"""
hash_password first_arg: Comeonin.Bcrypt.hashpwsalt
verify_password first_arg: Comeonin.Bcrypt.checkpw
""")
    + _patterns("auth", "elixir", "ueberauth", r"""
oauth none: Ueberauth.Strategy.Helpers.callback_url Ueberauth.run_request Ueberauth.run_callback
""")
    + _patterns("auth", "python", "flask_login", r"""
login first_arg: login_user
logout none: logout_user
authenticate none: current_user
authorize none: login_required fresh_login_required
""")
    + _patterns("auth", "python", "django", r"""
authenticate none: authenticate
login none: login
logout none: logout
authenticate none: get_user
register none: User.objects.create_user User.objects.create_superuser
verify_password none: check_password
hash_password none: make_password set_password
authorize receiver: ~\.has_perm$ ~\.has_perms$
authorize first_arg: permission_required
authorize none: login_required
""")
    + _patterns("auth", "python", "pyjwt", r"""
generate_token first_arg: jwt.encode
verify_token first_arg: jwt.decode
""")
    + _patterns("auth", "python", "jose", r"""
generate_token first_arg: jose.jwt.encode
verify_token first_arg: jose.jwt.decode
generate_token first_arg: jose.jws.sign
verify_token first_arg: jose.jws.verify
""")
    + _patterns("auth", "python", "passlib", r"""
hash_password first_arg: ~\.hash$
verify_password first_arg: ~\.verify$
hash_password first_arg: passlib.hash.bcrypt.hash
verify_password first_arg: passlib.hash.bcrypt.verify
hash_password first_arg: passlib.hash.argon2.hash
verify_password first_arg: passlib.hash.argon2.verify
""")
    + _patterns("auth", "ruby", "devise", r"""
login first_arg: sign_in
logout first_arg: sign_out
authenticate none: authenticate_user! current_user user_signed_in? ~authenticate_.*!$ ~current_.*$ ~.*_signed_in\?$
""")
    + _patterns("auth", "ruby", "warden", r"""
authenticate none: warden.authenticate warden.authenticate! warden.authenticated? warden.user
login first_arg: warden.set_user
logout none: warden.logout
""")
    + _patterns("auth", "ruby", "bcrypt_ruby", r"""
hash_password first_arg: BCrypt::Password.create
verify_password first_arg: BCrypt::Password.new
verify_password none: ~==
""")
    + _patterns("auth", "javascript", "passport", r"""
authenticate first_arg: passport.authenticate
session none: passport.serializeUser passport.deserializeUser
authenticate none: passport.use
session none: passport.initialize passport.session
login first_arg: req.login req.logIn
logout none: req.logout req.logOut
authenticate none: req.isAuthenticated req.isUnauthenticated req.user
""")
    + _patterns("auth", "javascript", "jsonwebtoken", r"""
generate_token first_arg: jwt.sign
verify_token first_arg: jwt.verify jwt.decode
generate_token first_arg: jsonwebtoken.sign
verify_token first_arg: jsonwebtoken.verify jsonwebtoken.decode
""")
    + _patterns("auth", "javascript", "bcryptjs", r"""
hash_password first_arg: bcrypt.hash bcrypt.hashSync
verify_password first_arg: bcrypt.compare bcrypt.compareSync
hash_password none: bcrypt.genSalt bcrypt.genSaltSync
""")
    + _patterns("auth", "javascript", "auth0", r"""
refresh_token none: auth0.getAccessTokenSilently
login none: auth0.loginWithRedirect auth0.loginWithPopup
logout none: auth0.logout
authenticate none: auth0.isAuthenticated auth0.getUser
oauth none: auth0.handleRedirectCallback
""")
    + _patterns("cache", "elixir", "cachex", r"""
get first_arg: Cachex.get Cachex.get!
set first_arg: Cachex.put Cachex.put!
delete first_arg: Cachex.del Cachex.del!
clear none: Cachex.clear Cachex.clear!
exists first_arg: Cachex.exists?
expire first_arg: Cachex.expire Cachex.expire!
ttl first_arg: Cachex.ttl Cachex.ttl!
increment first_arg: Cachex.incr Cachex.incr!
decrement first_arg: Cachex.decr Cachex.decr!
fetch first_arg: Cachex.fetch Cachex.fetch!
get first_arg: Cachex.take Cachex.take!
""")
    + _patterns("cache", "elixir", "concache", r"""
get first_arg: ConCache.get
set first_arg: ConCache.put
delete first_arg: ConCache.delete
fetch first_arg: ConCache.get_or_store
set first_arg: ConCache.update ConCache.update_existing ConCache.dirty_put
delete first_arg: ConCache.dirty_delete
""")
    + _patterns("cache", "elixir", "nebulex", r"""
get first_arg: *.get *.get!
set first_arg: *.put *.put!
delete first_arg: *.delete *.delete!
clear none: *.delete_all *.delete_all!
fetch first_arg: *.get_and_update *.get_and_update!
exists first_arg: *.has_key?
ttl first_arg: *.ttl
expire first_arg: *.expire
increment first_arg: *.incr
decrement first_arg: *.decr
""")
    + _patterns("cache", "elixir", "ets", r"""
get first_arg: :ets.lookup
set first_arg: :ets.insert
delete first_arg: :ets.delete
clear none: :ets.delete_all_objects
exists first_arg: :ets.member
increment first_arg: :ets.update_counter
""")
    + _patterns("cache", "python", "redis_py", r"""
get first_arg: redis.get
set first_arg: redis.set redis.setex redis.setnx
delete first_arg: redis.delete
clear none: redis.flushdb redis.flushall
exists first_arg: redis.exists
expire first_arg: redis.expire
ttl first_arg: redis.ttl
increment first_arg: redis.incr redis.incrby
decrement first_arg: redis.decr redis.decrby
get first_arg: r.get
set first_arg: r.set
delete first_arg: r.delete
exists first_arg: r.exists
expire first_arg: r.expire
increment first_arg: r.incr
decrement first_arg: r.decr
""")
    + _patterns("cache", "python", "django_cache", r"""
get first_arg: cache.get
set first_arg: cache.set
delete first_arg: cache.delete
clear none: cache.clear
fetch first_arg: cache.get_or_set
set first_arg: cache.add
increment first_arg: cache.incr
decrement first_arg: cache.decr
expire first_arg: cache.touch
exists first_arg: cache.has_key
get first_arg: caches[*].get
set first_arg: caches[*].set
""")
    + _patterns("cache", "python", "flask_cache", r"""
get first_arg: cache.get
set first_arg: cache.set
delete first_arg: cache.delete
clear none: cache.clear
fetch none: cache.cached cache.memoize
invalidate first_arg: cache.delete_memoized
""")
    + _patterns("cache", "ruby", "rails_cache", r"""
get first_arg: Rails.cache.read
set first_arg: Rails.cache.write
delete first_arg: Rails.cache.delete
clear none: Rails.cache.clear
exists first_arg: Rails.cache.exist?
fetch first_arg: Rails.cache.fetch
increment first_arg: Rails.cache.increment
decrement first_arg: Rails.cache.decrement
invalidate first_arg: Rails.cache.delete_matched
""")
    + _patterns("cache", "ruby", "dalli", r"""
get first_arg: dalli.get
set first_arg: dalli.set
delete first_arg: dalli.delete
clear none: dalli.flush
fetch first_arg: dalli.fetch
increment first_arg: dalli.incr
decrement first_arg: dalli.decr
expire first_arg: dalli.touch
""")
    + _patterns("cache", "ruby", "redis_rb", r"""
get first_arg: ~redis\.get$
set first_arg: ~redis\.set$
delete first_arg: ~redis\.del$
clear none: ~redis\.flushdb$
exists first_arg: ~redis\.exists\?$
expire first_arg: ~redis\.expire$
ttl first_arg: ~redis\.ttl$
increment first_arg: ~redis\.incr$
decrement first_arg: ~redis\.decr$
""")
    + _patterns("cache", "javascript", "node_cache", r"""
get first_arg: cache.get
set first_arg: cache.set
delete first_arg: cache.del
clear none: cache.flushAll
exists first_arg: cache.has
ttl first_arg: cache.ttl cache.getTtl
get first_arg: myCache.get
set first_arg: myCache.set
delete first_arg: myCache.del
""")
    + _patterns("cache", "javascript", "ioredis", r"""
get first_arg: redis.get
set first_arg: redis.set redis.setex
delete first_arg: redis.del
clear none: redis.flushdb redis.flushall
exists first_arg: redis.exists
expire first_arg: redis.expire
ttl first_arg: redis.ttl
increment first_arg: redis.incr redis.incrby
decrement first_arg: redis.decr redis.decrby
get first_arg: client.get
set first_arg: client.set
delete first_arg: client.del
exists first_arg: client.exists
expire first_arg: client.expire
increment first_arg: client.incr
decrement first_arg: client.decr
""")
    + _patterns("queue", "elixir", "broadway", r"""
consume none: Broadway.start_link
publish first_arg: Broadway.push_messages Broadway.test_message Broadway.Producer.push_messages
""")
    + _patterns("queue", "elixir", "oban", r"""
enqueue first_arg: Oban.insert Oban.insert! Oban.insert_all Oban.insert_all!
consume first_arg: Oban.start_queue Oban.stop_queue Oban.pause_queue Oban.resume_queue
retry first_arg: Oban.retry_job
retry none: Oban.retry_all_jobs
reject first_arg: Oban.cancel_job
enqueue none: *.new
process none: perform
""")
    + _patterns("queue", "elixir", "genstage", r"""
consume none: GenStage.start_link
subscribe first_arg: GenStage.sync_subscribe GenStage.async_subscribe
consume none: GenStage.demand
publish none: GenStage.reply
""")
    + _patterns("queue", "elixir", "amqp", r"""
publish first_arg: AMQP.Basic.publish
consume first_arg: AMQP.Basic.consume
acknowledge none: AMQP.Basic.ack
reject none: AMQP.Basic.nack AMQP.Basic.reject
dequeue first_arg: AMQP.Basic.get
subscribe first_arg: AMQP.Queue.declare AMQP.Queue.bind AMQP.Exchange.declare
""")
    + _patterns("queue", "python", "celery", r"""
enqueue receiver: task.delay task.apply_async task.apply
enqueue first_arg: celery.send_task app.send_task
enqueue receiver: ~\.delay$ ~\.apply_async$
process none: celery.task app.task
retry none: retry
""")
    + _patterns("queue", "python", "rq", r"""
enqueue first_arg: queue.enqueue
schedule first_arg: queue.enqueue_at queue.enqueue_in
enqueue first_arg: Queue.enqueue
consume none: job.get_status
reject none: job.cancel
retry none: job.requeue
process none: Worker.work
""")
    + _patterns("queue", "python", "kombu", r"""
publish first_arg: producer.publish
publish none: connection.Producer
consume none: connection.Consumer consumer.consume
acknowledge none: message.ack
reject none: message.reject
retry none: message.requeue
subscribe first_arg: Queue Exchange
""")
    + _patterns("queue", "ruby", "sidekiq", r"""
enqueue receiver: *.perform_async
schedule receiver: *.perform_in *.perform_at
enqueue first_arg: Sidekiq::Client.push Sidekiq::Client.push_bulk
process none: perform
retry none: sidekiq_retry_in
""")
    + _patterns("queue", "ruby", "activejob", r"""
enqueue receiver: *.perform_later
process receiver: *.perform_now
schedule receiver: *.set
subscribe first_arg: ActiveJob::Base.queue_as
process none: perform
retry none: retry_job
reject none: discard_on
""")
    + _patterns("queue", "ruby", "resque", r"""
enqueue first_arg: Resque.enqueue
schedule first_arg: Resque.enqueue_at Resque.enqueue_in
dequeue first_arg: Resque.dequeue
consume first_arg: Resque.reserve
process none: perform
""")
    + _patterns("queue", "javascript", "bullmq", r"""
enqueue first_arg: queue.add queue.addBulk
consume first_arg: queue.getJob
consume none: queue.getJobs queue.pause queue.resume
subscribe first_arg: worker.on
consume first_arg: Worker
acknowledge none: job.moveToCompleted
reject none: job.moveToFailed
retry none: job.retry
dequeue none: job.remove
""")
    + _patterns("queue", "javascript", "amqplib", r"""
publish first_arg: channel.publish channel.sendToQueue
consume first_arg: channel.consume
acknowledge none: channel.ack
reject none: channel.nack channel.reject
subscribe first_arg: channel.assertQueue channel.assertExchange channel.bindQueue
dequeue first_arg: channel.get
""")
    + _patterns("queue", "javascript", "agenda", r"""
subscribe first_arg: agenda.define
schedule first_arg: agenda.every agenda.schedule
enqueue first_arg: agenda.now
consume none: agenda.start agenda.stop
reject first_arg: agenda.cancel
schedule first_arg: job.repeatEvery job.schedule
enqueue none: job.save
""")
    + _patterns("file", "elixir", "elixir_file", r"""
read first_arg: File.read File.read!
write first_arg: File.write File.write!
open first_arg: File.open File.open!
close first_arg: File.close
delete first_arg: File.rm File.rm! File.rm_rf File.rm_rf!
copy first_arg: File.cp File.cp! File.cp_r File.cp_r!
move first_arg: File.rename File.rename!
exists first_arg: File.exists?
stat first_arg: File.stat File.stat!
mkdir first_arg: File.mkdir File.mkdir! File.mkdir_p File.mkdir_p!
rmdir first_arg: File.rmdir File.rmdir!
list first_arg: File.ls File.ls!
read first_arg: File.stream!
""")
    + _patterns("file", "elixir", "elixir_io", r"""
read first_arg: IO.read
write first_arg: IO.write
read first_arg: IO.binread
write first_arg: IO.binwrite
read first_arg: IO.gets
write first_arg: IO.puts
""")
    + _patterns("file", "python", "python_builtin", r"""
open first_arg: open
read none: file.read
write none: file.write
close none: file.close
read none: file.readline file.readlines
write none: file.writelines
read none: f.read
write none: f.write
close none: f.close
""")
    + _patterns("file", "python", "python_os", r"""
delete first_arg: os.remove os.unlink
move first_arg: os.rename os.replace
mkdir first_arg: os.mkdir os.makedirs
rmdir first_arg: os.rmdir os.removedirs
list first_arg: os.listdir os.scandir
stat first_arg: os.stat
exists first_arg: os.path.exists os.path.isfile os.path.isdir
""")
    + _patterns("file", "python", "pathlib", r"""
read receiver: ~\.read_text$ ~\.read_bytes$
write receiver: ~\.write_text$ ~\.write_bytes$
delete receiver: ~\.unlink$
move receiver: ~\.rename$ ~\.replace$
mkdir receiver: ~\.mkdir$
rmdir receiver: ~\.rmdir$
list receiver: ~\.iterdir$
exists receiver: ~\.exists$ ~\.is_file$ ~\.is_dir$
stat receiver: ~\.stat$
open receiver: ~\.open$
stat first_arg: Path
""")
    + _patterns("file", "python", "shutil", r"""
copy first_arg: shutil.copy shutil.copy2 shutil.copyfile shutil.copytree
move first_arg: shutil.move
delete first_arg: shutil.rmtree
""")
    + _patterns("file", "ruby", "ruby_file", r"""
read first_arg: File.read
write first_arg: File.write
open first_arg: File.open
delete first_arg: File.delete File.unlink
move first_arg: File.rename
exists first_arg: File.exist? File.exists? File.file? File.directory?
stat first_arg: File.stat File.size
mkdir first_arg: Dir.mkdir
rmdir first_arg: Dir.rmdir Dir.delete
list first_arg: Dir.entries Dir.glob Dir.foreach
""")
    + _patterns("file", "ruby", "fileutils", r"""
copy first_arg: FileUtils.cp FileUtils.copy FileUtils.cp_r
move first_arg: FileUtils.mv FileUtils.move
delete first_arg: FileUtils.rm FileUtils.rm_f FileUtils.rm_r FileUtils.rm_rf
mkdir first_arg: FileUtils.mkdir FileUtils.mkdir_p
rmdir first_arg: FileUtils.rmdir
write first_arg: FileUtils.touch
""")
    + _patterns("file", "javascript", "nodejs_fs", r"""
read first_arg: fs.readFile fs.readFileSync
write first_arg: fs.writeFile fs.writeFileSync
append first_arg: fs.appendFile fs.appendFileSync
delete first_arg: fs.unlink fs.unlinkSync fs.rm fs.rmSync
copy first_arg: fs.copyFile fs.copyFileSync fs.cp fs.cpSync
move first_arg: fs.rename fs.renameSync
exists first_arg: fs.existsSync
stat first_arg: fs.stat fs.statSync fs.lstat fs.lstatSync
mkdir first_arg: fs.mkdir fs.mkdirSync
rmdir first_arg: fs.rmdir fs.rmdirSync
list first_arg: fs.readdir fs.readdirSync
open first_arg: fs.open fs.openSync
close first_arg: fs.close fs.closeSync
read first_arg: fs.createReadStream
write first_arg: fs.createWriteStream
""")
    + _patterns("file", "javascript", "nodejs_fs_promises", r"""
read first_arg: fsPromises.readFile
write first_arg: fsPromises.writeFile
append first_arg: fsPromises.appendFile
delete first_arg: fsPromises.unlink fsPromises.rm
copy first_arg: fsPromises.copyFile fsPromises.cp
move first_arg: fsPromises.rename
stat first_arg: fsPromises.stat
mkdir first_arg: fsPromises.mkdir
rmdir first_arg: fsPromises.rmdir
list first_arg: fsPromises.readdir
open first_arg: fsPromises.open
exists first_arg: fsPromises.access
""")
    + _patterns("external_api", "elixir", "ex_aws", r"""
call first_arg: ExAws.request ExAws.request!
upload first_arg: ExAws.S3.put_object
download first_arg: ExAws.S3.get_object
call first_arg: ExAws.S3.delete_object
search first_arg: ExAws.S3.list_objects
send none: ExAws.SES.send_email
send first_arg: ExAws.SNS.publish ExAws.SQS.send_message
call first_arg: ExAws.Lambda.invoke
""")
    + _patterns("external_api", "elixir", "stripe", r"""
charge none: Stripe.Charge.create Stripe.PaymentIntent.create
charge first_arg: Stripe.PaymentIntent.confirm
call none: Stripe.Customer.create
call first_arg: Stripe.Customer.retrieve
charge none: Stripe.Subscription.create Stripe.Refund.create
webhook none: Stripe.Webhook.construct_event
""")
    + _patterns("external_api", "elixir", "twilio", r"""
send none: ExTwilio.Message.create ExTwilio.Call.create
call first_arg: ExTwilio.Message.find
""")
    + _patterns("external_api", "python", "boto3", r"""
upload none: client.put_object
download none: client.get_object
call none: client.delete_object
search none: client.list_objects
send none: client.send_email client.publish client.send_message
call first_arg: client.invoke
upload first_arg: s3.upload_file
download first_arg: s3.download_file
upload none: s3.upload_fileobj
download none: s3.download_fileobj
call first_arg: boto3.client boto3.resource
""")
    + _patterns("external_api", "python", "stripe", r"""
charge none: stripe.Charge.create stripe.PaymentIntent.create stripe.PaymentIntent.confirm
call none: stripe.Customer.create
call first_arg: stripe.Customer.retrieve
charge none: stripe.Subscription.create stripe.Refund.create
webhook none: stripe.Webhook.construct_event
""")
    + _patterns("external_api", "python", "twilio", r"""
send none: client.messages.create client.calls.create
call none: twilio.rest.Client
""")
    + _patterns("external_api", "python", "sendgrid", r"""
send first_arg: sendgrid.send sg.send
send none: Mail
""")
    + _patterns("external_api", "ruby", "aws_sdk", r"""
upload none: client.put_object
download none: client.get_object
call none: client.delete_object
search none: client.list_objects
upload none: s3.put_object
download none: s3.get_object
call none: Aws::S3::Client.new Aws::S3::Resource.new
""")
    + _patterns("external_api", "ruby", "stripe", r"""
charge none: Stripe::Charge.create Stripe::PaymentIntent.create Stripe::PaymentIntent.confirm
call none: Stripe::Customer.create
call first_arg: Stripe::Customer.retrieve
charge none: Stripe::Subscription.create Stripe::Refund.create
webhook none: Stripe::Webhook.construct_event
""")
    + _patterns("external_api", "ruby", "twilio", r"""
send none: client.messages.create client.calls.create
call none: Twilio::REST::Client.new
""")
    + _patterns("external_api", "javascript", "aws_sdk_js", r"""
upload none: s3.putObject
download none: s3.getObject
call none: s3.deleteObject
search none: s3.listObjects
upload none: s3.upload
send none: ses.sendEmail sns.publish sqs.sendMessage
call none: lambda.invoke
call first_arg: client.send
call none: S3Client
upload none: PutObjectCommand
download none: GetObjectCommand
""")
    + _patterns("external_api", "javascript", "stripe", r"""
charge none: stripe.charges.create stripe.paymentIntents.create stripe.paymentIntents.confirm
call none: stripe.customers.create
call first_arg: stripe.customers.retrieve
charge none: stripe.subscriptions.create stripe.refunds.create
webhook none: stripe.webhooks.constructEvent
""")
    + _patterns("external_api", "javascript", "twilio", r"""
send none: client.messages.create client.calls.create
call none: twilio
""")
    + _patterns("external_api", "javascript", "sendgrid", r"""
send first_arg: sgMail.send sgMail.sendMultiple client.send
""")
)
