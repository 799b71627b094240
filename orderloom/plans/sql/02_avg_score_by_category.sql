-- Mean score per category over distinct (review, category) pairs.
WITH order_categories AS (
  SELECT DISTINCT i.order_id, coalesce(p.category, 'unknown') AS category
  FROM star_items AS i LEFT JOIN star_products AS p USING (product_id)
)
SELECT c.category, count(*) AS total_reviews, round(avg(r.review_score), 3) AS avg_review_score
FROM star_reviews AS r JOIN order_categories AS c USING (order_id)
GROUP BY c.category
HAVING count(*) >= :category_min
ORDER BY avg_review_score DESC, c.category
