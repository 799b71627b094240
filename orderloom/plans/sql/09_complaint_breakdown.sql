-- Negative reviews by topic name, with their share of all negative reviews.
SELECT t.business_topic_name AS topic, count(*) AS negative_reviews,
       round(count(*) * 100D / sum(count(*)) OVER (), 1) AS share_of_negative_pct,
       round(avg(r.review_score), 3) AS avg_review_score
FROM star_reviews AS r JOIN star_topics AS t USING (topic_id)
WHERE r.sentiment_label = 'Negative'
GROUP BY t.business_topic_name
ORDER BY negative_reviews DESC, topic
