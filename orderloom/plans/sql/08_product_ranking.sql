-- Products by complaint rate over distinct (product, review) pairs.
WITH order_products AS (
  SELECT DISTINCT order_id, product_id FROM star_items
),
ranked AS (
  SELECT i.product_id, count(*) AS total_reviews, round(avg(r.review_score), 3) AS avg_score,
         round(avg(if(r.sentiment_label = 'Negative', 1D, 0D)), 4) AS negative_sentiment_rate
  FROM order_products AS i JOIN star_reviews AS r USING (order_id)
  GROUP BY i.product_id
  HAVING count(*) >= :product_min
)
SELECT product_id, coalesce(p.category, 'unknown') AS category, total_reviews, avg_score, negative_sentiment_rate
FROM ranked LEFT JOIN star_products AS p USING (product_id)
ORDER BY negative_sentiment_rate DESC, total_reviews DESC, product_id
